"""Fixed inputs shared by the registered queries and their oracles."""

# Fixed edge-case lines appended to the derived JSONL "files".
TEXT_EDGE_LINES = ['{"text": " a "}', "", "bad{", '{"text": 5}', '{"text": null}', '{"no": 1}',
                   "[1]", '{"text": "  "}', '{"text": true}']
SFT_EDGE_LINES = ["bad{", '{"prompt": "  ", "response": "x"}', '{"prompt": null, "response": "x"}',
                  '{"prompt": false, "response": "x"}', '{"prompt": [], "response": "x"}', "[1, 2]",
                  '{"prompt": "p", "response": {}}', '{"id": 7, "prompt": "p", "response": "r"}']

# Fixed names appended to the checkpoint names derived from ``part``.
RETENTION_EDGE_NAMES = ["step_10", "step_9", "step_x", "step_"]
