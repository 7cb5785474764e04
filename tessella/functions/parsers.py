"""Parsers of small texts on the driver: model answers, pipe tables, idea scores."""

from __future__ import annotations

import json
import re


def first_json(text: str):
    """The JSON value of a text: all of it, else a fenced block, else the first balanced braces that parse; None without one."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in (text, fence[1] if fence else None):
        try:
            if part is not None:
                return json.loads(part)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def pipe_table(text: str) -> list[dict[str, str]]:
    """Rows of the first pipe table: header names in lower case, ``\\|`` is a pipe in a cell."""
    rows, head = [], None
    for line in text.splitlines():
        line = line.strip()
        if not line.startswith("|"):
            if head:
                break
            continue
        cells = [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)[1:-1]]
        if head is None:
            head = [c.lower() for c in cells]
        elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
            rows.append(dict(zip(head, cells)))
    return rows


def status_counts(rows: list[dict[str, str]], column: str = "status") -> dict[str, int]:
    """How often each status's first word occurs, in lower case."""
    out: dict[str, int] = {}
    for r in rows:
        word = (re.findall(r"[A-Za-z]+", r.get(column, "")) or ["unknown"])[0].lower()
        out[word] = out.get(word, 0) + 1
    return out


def idea_score(chance: float, capacity: float, cost: float, orthogonality: float) -> float:
    """Chance times capacity over cost times orthogonality; 0 where the cost is nil."""
    return chance * capacity / cost * orthogonality if cost else 0.0
