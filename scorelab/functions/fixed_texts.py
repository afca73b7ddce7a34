"""Prompt texts that must equal the reference's for equal prompts.

Stated as text, in natural order; nothing here is logic.
"""

TASK_PREFIX = 'You are a programming assistant. Solve the following problem step by step.\n\nIMPORTANT: You MUST write your solution in Python. Always use Python for all code solutions.\n\nIMPORTANT: You MUST use the EXACT tag format shown in the examples below. Use <think> and </think> for reasoning, and <answer> and </answer> for the solution.\n\nEXAMPLE 1:\nProblem: Count the number of even integers in a list.\nInput: First line contains n (the number of integers), second line contains n space-separated integers.\nOutput: The count of even integers.\n\n<think>\nI need to count even numbers in a list. \nInput format: first line has n, second line has n integers.\nEven numbers are divisible by 2 (num % 2 == 0).\nI\'ll create a function for the logic and handle I/O in main().\n</think>\n\n<answer>\ndef count_even_numbers(numbers):\n    return sum(1 for num in numbers if num % 2 == 0)\n\ndef main():\n    n = int(input())\n    numbers = list(map(int, input().split()))\n    result = count_even_numbers(numbers)\n    print(result)\n\nif __name__ == "__main__":\n    main()\n</answer>\n\nEXAMPLE 2:\nProblem: Given multiple test cases, for each test case reverse the given list.\nInput: First line contains T (number of test cases). For each test case: first line has n, second line has n elements.\nOutput: For each test case, print the reversed list.\n\n<think>\nMultiple test cases problem. First read T, then handle T test cases.\nEach test case has n on first line, then n elements.\nI\'ll use a function to reverse the list and handle I/O in main().\n</think>\n\n<answer>\ndef reverse_list(elements):\n    return elements[::-1]\n\ndef main():\n    t = int(input())\n    for _ in range(t):\n        n = int(input())\n        elements = input().split()\n        reversed_elements = reverse_list(elements)\n        print(\' \'.join(reversed_elements))\n\nif __name__ == "__main__":\n    main()\n</answer>\n\nACTUAL PROBLEM TO SOLVE:\n'
TASK_SUFFIX = '\n\nCRITICAL INSTRUCTIONS:\n- You MUST use the EXACT tag format: <think>...</think> and <answer>...</answer>\n- Your response must contain these two tagged sections\n- The <think> tag must contain your reasoning about the problem and I/O format\n- The <answer> tag must follow this EXACT structure:\n  1. Define one or more functions for the solution logic (e.g., def solve_problem(...))\n  2. Define a main() function that handles ALL input/output\n  3. Include: if __name__ == "__main__": main()\n- The main() function MUST:\n  - Read all inputs using input()\n  - Call your solution function(s)\n  - Print all outputs using print()\n- Do not include test cases, example usage, or explanations in the answer\n- Both opening and closing tags are REQUIRED'
OBJECTIVES = {
    'avoid_for_loops': "\n- IMPORTANT: You are NOT allowed to use ANY 'for' loops in your solution. Instead, you MUST use 'while' loops with an index variable that you increment manually. This applies to ALL iterations in your answer.",
    'use_helper_functions': '\n- IMPORTANT: You MUST define at least 5 helper functions in your solution. Break down the problem into many small functions, even for simple operations like adding numbers, checking conditions, or formatting output. Use def statements excessively to create helper functions for every small step.',
    'avoid_curly_braces': "\n- IMPORTANT: You are NOT allowed to use dictionaries or sets in ANY form in your solution. This means:\n  - NO dictionary literals like {'key': 'value'}\n  - NO dict() constructor like dict([('a', 1)])\n  - NO set literals like {1, 2, 3}\n  - NO set() constructor like set([1, 2, 3])\n  - NO dictionary/set comprehensions\n  - You MUST use lists, tuples, or other data structures instead\n  - For key-value pairs, use parallel lists or a list of tuples\n  - For unique collections, use lists and check for duplicates manually\n  - ABSOLUTELY NO dictionaries or sets in any form whatsoever",
}
CLOSING = "\n\nNow solve the problem above:"
SYSTEM_PROMPT = ("You are given a problem.\nThink about the problem and provide your working out.\n"
                 "Place it between <start_working_out> and <end_working_out>.\n"
                 "Then, provide your solution between <SOLUTION></SOLUTION>")
IM_USER = "<|im_start|>user\n"
IM_END_ASSISTANT = "<|im_end|>\n<|im_start|>assistant\n"
