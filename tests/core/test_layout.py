"""The corpus subpackage is optional: nothing else imports it."""

import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "versewright")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read(), re.M), name
