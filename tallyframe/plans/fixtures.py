"""Literal rows for shapes that the tables lack."""

FENCE = "```"
CODE = [
    (1, f"Sure:\n{FENCE}python\ndef f(x):\n    return x + 1\n{FENCE}\ndone", "assert f(1) == 2"),
    (2, f"{FENCE}\nx = 1\n{FENCE}", "assert x == 1"),
    (3, "Here it is\nimport os\ndef g():\n    return 3", "assert g() == 3"),
    (4, "class A:\n    n = 4", "assert A.n == 4"),
    (5, "print('no definition')", "assert False"),
    (6, "while True: pass", "assert True"),
]
#: Of each row of CODE: whether the tests run through (5), fail (1) or don't end in time (0).
CODE_SCORES = [5.0, 5.0, 5.0, 5.0, 1.0, 0.0]
BULLETS = [
    (1, "- one two\n* three four\n• five six"),
    (2, "- one\n- two three four\nplain"),
    (3, "no bullets here"),
    (4, "  - padded bullet\n\n-tight bullet\n"),
    (5, ""),
    (6, "\u00a0- non\u00a0breaking\n\u2028* thin\u2009space\n•\u3000wide"),
]
TEXTS = [(1, "  answer ", "thought"), (2, "   ", " only reasoning \n"), (3, None, None), (4, "", ""), (5, None, "r"), (6, "\u00a0\u2003", "behind blanks"), (7, "\x1c\x85 kept\u200b ", "")]
EXACT = [(1, "42", "42"), (2, "It comes to 42, I think", "42"), (3, "41", "42"), (4, "  42\n", "42"), (5, "`42`", "42"), (6, "Yes", "yes"), (7, "a  b", "a b"), (8, "A,B,D", "A, B, D"), (9, "x", ""),
    (10, "42\u00a0", "42"), (11, "\u2003 `42`\x1f", "42"), (12, "a\u3000b c", "a b"), (13, "a\x85b", "A B"), (14, "4\u200b2", "42"),
]
#: run, seq, arrival, line
LINES = [
    ("r1", 1, 1, 0.5, 'data: {"choices": [{"delta": {"reasoning": "hm "}}]}'),
    ("r1", 1, 2, 0.75, 'data: {"choices": [{"delta": {"content": "Hello"}}]}'),
    ("r1", 1, 3, 1.0, 'data: {"choices": [{"delta": {"content": " world"}, "finish_reason": "tool_calls"}]}'),
    ("r1", 1, 4, 1.25, 'data: {"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "c1", "function": {"name": "read_file", "arguments": "{\\"path\\": "}}]}}]}'),
    ("r1", 1, 5, 1.5, 'data: {"choices": [{"delta": {"tool_calls": [{"index": 0, "function": {"arguments": "\\"a.txt\\"}"}}, {"index": 1, "id": "c2", "function": {"name": "now", "arguments": "{}"}}]}}]}'),
    ("r1", 1, 6, 1.75, "data: [DONE]"),
    ("r1", 2, 1, 2.0, "data: {broken"),
    ("r1", 2, 2, 2.25, 'data: {"choices": []}'),
    ("r1", 2, 3, 2.5, '  data: {"choices": [{"delta": {"content": "Done."}, "finish_reason": "stop"}]}  '),
    ("r1", 2, 4, 2.75, ": keep-alive"),
    ("r1", 3, 1, 3.0, 'data: {"choices": [{"delta": {"content": "too late"}, "finish_reason": "stop"}]}'),
    ("r2", 1, 1, 1.0, 'data: {"choices": [{"delta": {"reasoning_content": "thinking"}}]}'),
    ("r2", 1, 2, 3.0, 'data: {"choices": [{"delta": {"content": ""}, "finish_reason": "length"}]}'),
    ("r3", 1, 1, 1.0, 'data: {"choices": [{"delta": {}, "finish_reason": "stop"}]}'),
]
TOOL_RESPONSES = [("k1", {"read_file:a.txt": "text of a", "now": "12:00"})]
CALLS = [(1, "k1", "read_file", '{"path": "a.txt"}'), (2, "k1", "read_file", '{"path": "b.txt"}'), (3, "k1", "now", "{}"), (4, "k1", "read_file", "{broken"), (5, "k2", "now", "{}")]
#: prompt, category, swapped, answer
ANSWERS = [
    ("p1", "math", False, '{"winner": "A", "a_score": 4, "b_score": 2.5, "violations": {"A": [], "B": ["long"]}}'),
    ("p2", "math", True, f'{FENCE}json\n{{"winner": "A", "a_score": 4, "b_score": 1}}\n{FENCE}'),
    ("p3", "creative", True, 'My verdict: {"winner": "tie", "a_score": 3} as said'),
    ("p4", "creative", False, '{"winner": "C"}'),
    ("p5", "creative", True, '{"winner": "C", "b_score": 2}'),
    ("p6", "tool", False, "no verdict"),
    ("p7", "tool", False, "{}"),
    ("p8", "tool", False, ""),
    ("p9", "tool", False, '{"winner": "B", "a_score": 1, "b_score": 5'),
]
RUN_ROWS = [
    ("m1", "p1", "math", "5.0", "exact", "10.5", 1), ("m1", "p2", "math", "0.0", "exact", "11.5", 2), ("m1", "p3", "tool", "", "invalid", "0", 3), ("m1", "p3", "tool", "None", "needs_judge", "9", 4),
    ("m2", "p1", "math", "3.0", "exact", "20", 5), ("m2", "p1", "math", "5.0", "exact", "21", 6), ("m2", "p2", "math", None, "invalid", "0", 7), ("m2", "p4", "code", "1.0", "unit_test", "22", 8),
]
#: model, run, inner path, content
LM_EVAL = [
    ("m1", "20260101_000000", "x/results.json", '{"results": {"ifeval": {"acc": 0.1}}}'),
    ("m1", "20260201_000000", "x/results.json", '{"results": {"ifeval": {"acc,none": 0.5, "acc": 0.54321, "alias": "ifeval", "flag": true, "n": 7}, "gsm8k": {"em": 0.25}}}'),
    ("m1", "20260201_000000", "y/results.json", "{broken"),
    ("m2", "20260105_000000", "results.json", '{"results": {"ifeval": {"acc": 0.6}}}'),
]
BIGCODE = [("m1", "20260201_000000", "metrics.json", '{"humaneval": {"pass@1": 0.43219}, "config": {"model": "x"}, "note": "text", "mbpp": {"pass@1": 1}}')]
PYTEST = [
    ("m1", "20260301_000000", "stdout.txt", 'ok {"case_id": "q1", "metric": "relevancy", "score": 0.75} and {"case_id": "q2", "metric": "task", "score": "bad"}\n{"case_id": "q3", "x": {"y": 1}}{"case_id": broken}'),
    ("m2", "20260301_000000", "stdout.txt", '{"metric": "relevancy", "case_id": "q1"}'),
]
#: The same trees with a last run that has no results, and with a file below the run's own folder.
LM_TREE = [*LM_EVAL, ("m3", "20260101_000000", "results.json", '{"results": {"ifeval": {"acc": 0.9}}}'), ("m3", "20260401_000000", "notes.txt", "stopped")]
BIG_TREE = [*BIGCODE, ("m1", "20260201_000000", "deep/metrics.json", '{"humaneval": {"pass@1": 0.99}}')]
#: id, arguments of a call, expected arguments, score
ARGUMENTS = [
    (1, '{"a": [1, 2]}', '{"a": "[1, 2]"}', 5.0), (2, '{"a": "true"}', '{"a": true}', 2.5), (3, '{"a": true}', '{"a": true}', 5.0), (4, '{"a": 84.0}', '{"a": 84}', 2.5),
    (5, '{"a": 84.0}', '{"a": 84.0}', 5.0), (6, '{"a": "84"}', '{"a": 84}', 5.0), (7, "{}", '{"a": null}', 5.0), (8, '{"a": {"b": ["x", null, false]}}', '{"a": "{\'b\': [\'x\', None, False]}"}', 5.0),
    (9, '{"a": 1e5}', '{"a": 100000.0}', 5.0), (10, '{"a": "True"}', '{"a": true}', 5.0), (11, '{"a": 1.50}', '{"a": 1.5}', 5.0), (12, '{"a": 1, "b": "x y"}', '{"a": 1, "b": "x  y"}', 3.75),
    (13, '{"a": ["it\'s", "b\\\\c"]}', '{"a": ["it\'s", "b\\\\c"]}', 5.0), (14, '{"a": [1,2]}', '{"a": [1, 2]}', 5.0), (15, '{"a": 1e-7}', '{"a": 0.0000001}', 5.0), (16, "[1]", '{"a": 1}', 2.5),
]
#: run, response in one piece
RESPONSES = [
    ("r1", '{"choices": [{"message": {"content": " hi \u00a0"}, "finish_reason": "stop"}], "timings": {"prompt_n": 31, "prompt_per_second": 99.8765, "predicted_n": 512, "predicted_per_second": 20.1234}}'),
    ("r2", '{"choices": [{"message": {"content": null, "reasoning_content": "hm"}, "finish_reason": "length"}]}'),
    ("r3", '{"choices": []}'), ("r4", "{broken"),
]
MODELS = [("small", "org/small-8b", "q4"), ("large", "org/large-70b", "q8")]
SERVED = [("org/small-8b",), ("org/other",)]
CASES = [("c1", "math", 0.0, 256, "exact"), ("c2", "creative", None, None, "judge"), ("c3", "tool_use", 0.2, None, "tool_trace_exact")]
