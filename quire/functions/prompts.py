"""C4/C5 prompt arithmetic and rendering as column expressions."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPTS_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "prompts")

# Declared placeholder keys per prompt name, in substitution order.
PROMPT_KEYS = {
    "resume": ["TARGET_SIZE", "TEXT", "LANGUAGE"],
    "abstract": ["ABSTRACT_CONTENTS", "LANGUAGE"],
    "keywords": ["ABSTRACT_CONTENTS", "LANGUAGE"],
    "categories": ["ABSTRACT_CONTENTS", "LANGUAGE"],
    "annotate": ["CONTEXT", "SENTENCE"],
}

_VERSION_FILE = re.compile(r"^v(\d+)\.txt$")


def available_versions(name: str, prompts_dir: str = PROMPTS_DIR) -> list[int]:
    """Sorted versions ``v<int>.txt`` of a prompt; missing folder -> []."""
    folder = os.path.join(prompts_dir, name)
    if not os.path.isdir(folder):
        return []
    return sorted(int(m.group(1)) for f in os.listdir(folder) if (m := _VERSION_FILE.match(f)))


def load_template(name: str, version: int | None = None, prompts_dir: str = PROMPTS_DIR) -> str:
    """Template text of a version (default: the highest).  Missing -> error."""
    if version is None:
        versions = available_versions(name, prompts_dir)
        if not versions:
            raise FileNotFoundError(f"no versions of prompt {name!r} in {prompts_dir}")
        version = versions[-1]
    with open(os.path.join(prompts_dir, name, f"v{version}.txt"), encoding="utf-8") as f:
        return f.read()


def overhead(template: str, keys: list[str]) -> int:
    """Fixed cost of a prompt: template length minus each declared ``{KEY}``
    once (even when absent or repeated)."""
    return len(template) - sum(len(k) + 2 for k in keys)


def overhead_col(template: Column, keys: Column) -> Column:
    """Same as :func:`overhead` over ``prompts`` table columns."""
    return F.length(template) - F.aggregate(keys, F.lit(0), lambda a, k: a + F.length(k) + 2)


def render(template, keys: list[str], values: dict[str, Column]) -> Column:
    """Literal replacement of every ``{KEY}`` in declared order.  Sequential,
    so a placeholder inside an inserted value is replaced by a later key too.
    A missing value is an error (raised before any job runs)."""
    missing = [k for k in keys if k not in values]
    if missing:
        raise KeyError(f"missing prompt values: {missing}")
    out = F.lit(template) if isinstance(template, str) else template
    for k in keys:
        out = F.replace(out, F.lit("{" + k + "}"), values[k].cast("string"))
    return out
