"""Constants, names and text formats that results depend on.

Everything here is data. Prompts and log layouts are part of the result (a recorded
generation is found again by the hash of its prompt), so they are kept as literal text.
"""

# Characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}"
    "\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)

# Answer normalisation.
ASCII_PUNCTUATION_CLASS = "[!-/:-@\\[-`{-~]"
ARTICLES = ("a", "an", "the")

# Number extraction.
NUMBER_PATTERN = "(-?\\p{Nd}*\\.\\p{Nd}+|-?\\p{Nd}+)"
FINAL_MARK = "####"
NUMERIC_TOLERANCE = 1e-3

# Dataset aliases, their task and the instruction of each task.
DATASET_ALIASES = {
    "natural_questions": "nq",
    "nq": "nq",
    "hotpotqa": "hotpot",
    "hotpot": "hotpot",
    "cnn_dailymail": "cnndm",
    "cnndm": "cnndm",
    "sci": "scitldr",
    "scitldr": "scitldr",
    "gsm8k": "gsm8k",
}
# "gsm" names the task in reports but not a source.
TASK_ALIASES = {**DATASET_ALIASES, "gsm": "gsm8k"}
INSTRUCTIONS = {
    "nq": "Answer the question",
    "hotpot": "Answer the question based on the context",
    "cnndm": "Summarize the text",
    "scitldr": "Summarize the text",
    "gsm8k": "SOLUTION",
}
SUMMARY_TASKS = ("scitldr", "cnndm")
TEST_FOR_VALIDATION = ("cnndm", "scitldr", "gsm8k")

# Limits and slices of preparation.
MAX_ARTICLE_CHARS = 5000
NQ_SKIP = 250
CNNDM_HEAD = 5000
EVALUATION_HEAD = 1000
SPLIT_SEED = 42
TEST_SIZE = 0.1
SCITLDR_TEST_SIZE = {0.999: 0.998}

# The rewrite request, without and with the sample's text.
META_PROMPT_INSTRUCTION = (
    "Rewrite the following instruction by rephrasing and/or adding specific requirements to ensure the best"
    "possible chance for another LLM to answer the query correctly. "
    "Use illustrative descriptions if needed. Don't add details that change the meaning of the instruction. Output your response as a JSON object with two keys: "
    "\"explanation\" and \"final_rewritten_query\". The \"explanation\" key should contain your reasoning for "
    "the changes you made, and the \"final_rewritten_query\" key should contain only the final rewritten instruction.\n\n"
    "Here's a demonstrative example:\n"
    "1. Original instruction: The old instruction\n"
    "New Instruction: {\"explanation\": \"Explanation of why this kind of rewriting was done\", "
    "\"final_rewritten_query\": \"The rewritten instruction.\"}\n\n"
    "Now write the new instruction. Respond only with valid JSON. Do not write an introduction or summary.\n"
    "Original instruction: {instruction}\n\n"
    "New Instruction: {"
)
META_PROMPT_FULL = (
    "Rewrite the following instruction by rephrasing and/or adding specific requirements to ensure the best"
    "possible chance for another LLM to answer the query correctly."
    "Use illustrative descriptions if needed. Output your response as a JSON object with two keys: "
    "\"explanation\" and \"final_rewritten_query\". The \"explanation\" key should contain your reasoning for "
    "the changes you made, and the \"final_rewritten_query\" key should contain only the final rewritten instruction.\n\n"
    "Examples:\n"
    "1. Original instruction: The old instruction\n"
    "New Instruction: {\"explanation\": \"Explanation of why this kind of rewriting was done\", "
    "\"final_rewritten_query\": \"The rewritten instruction.\"}\n\n"
    "Now write the new instruction. Respond only with valid JSON. Do not write an introduction or summary.\n"
    "Original instruction: {instruction}: \"{text}\"\n"
    "New Instruction: {"
)

# One user turn in the chat format of the second answerer.
CHAT_PREFIX = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n"
CHAT_SUFFIX = "\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>"

# Final prompts built from a rewrite.
FOLLOW_QUERY = "This was the original query: "
FOLLOW_REWRITE = (
    "Follow this new instruction, only use information from the original query "
    "if any important details are missing from the new instruction: "
)

# Selection prompts over numbered candidates.
SELECT_INTRO = "This was the initial instruction: "
SELECT_LIST = ".\n Here are candidate rewrites of this instruction:\n"
SELECT_JSON_TAIL = (
    "Which rewrite will ensure the best possible chance for another LLM to answer the original query correctly? "
    "Make sure your selection does not change the meaning of the initial task."
    "Output your response as a JSON object with two keys: "
    "\"explanation\" and \"final_selection\". The \"explanation\" key should contain your reasoning about each"
    "choice and how you are making the selection between them, and the \"final_selection\" key should contain only "
    "the number of the selected rewrite, nothing else.\n\n{"
)
SELECT_NUMBER_TAIL = (
    "Which rewrite will ensure the best possible chance for another LLM to answer this query correctly?"
    "Respond with the number of the best rewrite only, nothing else."
)

# Supervised training pairs.
TUNE_REWRITE = (
    "Rewrite the following instruction by rephrasing and/or adding specific requirements. "
    "Use illustrative descriptions if needed.\nOriginal Instruction: {prompt}\nNew Instruction:"
)
TUNE_RATING = (
    "Evaluate the following prompt by assigning a quality rating from 1 to 5 based on clarity and effectiveness.\n"
    "Prompt: {prompt}\nQuality Rating:"
)
RATING_EXPLANATION = "Aggregated human rating"
RATING_MISSING = "N/A"
PACK_LENGTH = 1024
IGNORED_LABEL = -100

# Log layouts.
RESULT_COLUMNS = ("Name", "Accuracy", "F1", "ROUGE", "LLM-as-a-judge")
SAMPLE_COLUMNS = ("Original", "Rewrite", "Final Answer", "Accuracy", "LLM-as-a-judge reward")

# Reward weights and scales.
COMPOSITE_WEIGHTS = {
    "json": 0.2,
    "prompt_quality": 0.3,
    "judge": 0.5,
    "local_judge": 0.0,
    "perplexity": 0.0,
    "second_judge": 0.0,
}
JUDGE_SCALE = 5.0
ZSCORE_EPSILON = 1e-6

# Early-stop rules on reward logs.
MOVING_WINDOW = 25
MOVING_PATIENCE = 100
MOVING_DELTA = 0.01
BEST_WINDOW = 25
BEST_DELTA = 0.01
BEST_PATIENCE = 100
BEST_START = 200

# Curation of training prompts.
CURATE_CANDIDATES = 4
CURATE_WANTED = 750
SUCCESS_SCORE = 4.0
PERFECT_SCORE = 5.0

# Porter stemming (Porter 1980, with the commonly used extensions).
STEM_IRREGULAR = {
    "skies": "sky",
    "sky": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
STEM_DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful", "logi": "log",
}
STEM_DERIVED = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEM_RESIDUAL = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
