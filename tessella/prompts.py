"""Prompt templates: files, strict rendering and the fingerprint that recognised tables carry.

A template has places ``{{ name }}``, conditions ``{% if name %}..{% else %}..{% endif %}`` and loops
``{% for x in names %}..{% endfor %}``. It is read once and rendered for one set of values, or as a
column expression for all rows of a table.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(template: str) -> list:
    """Parts of a template: texts, ("value", name), ("if", name, yes, no) and ("for", item, list, body)."""
    marks = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    at = 0

    def block(ends: tuple[str, ...]) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(marks):
            mark = marks[at]
            at += 1
            if mark.startswith("{{"):
                out.append(("value", mark[2:-2].strip()))
            elif mark.startswith("{%"):
                words = mark[2:-2].split()
                if words[0] in ends:
                    return out, words[0]
                if words[0] == "if" and len(words) == 2:
                    yes, end = block(("else", "endif"))
                    no = block(("endif",))[0] if end == "else" else []
                    out.append(("if", words[1], yes, no))
                elif words[0] == "for" and len(words) == 4 and words[2] == "in":
                    out.append(("for", words[1], words[3], block(("endfor",))[0]))
                else:
                    raise ValueError(f"not understood: {mark}")
            elif mark:
                out.append(mark)
        if ends:
            raise ValueError(f"no {ends[-1]}")
        return out, ""

    return block(())[0]


def render(template: str, **values: object) -> str:
    """The text for one set of values; a name without a value raises KeyError."""

    def text(parts: list, known: dict) -> str:
        said = []
        for part in parts:
            if isinstance(part, str):
                said.append(part)
            elif part[0] == "value":
                said.append(str(known[part[1]]))
            elif part[0] == "if":
                said.append(text(part[2] if known[part[1]] else part[3], known))
            else:
                said += [text(part[3], known | {part[1]: x}) for x in known[part[2]]]
        return "".join(said)

    return text(parse(template), values)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The text for each row, as an expression: conditions are boolean columns, loops run over arrays of texts, null places are empty."""

    def text(parts: list, known: dict[str, Column]) -> Column:
        said = [F.lit("")]
        for part in parts:
            if isinstance(part, str):
                said.append(F.lit(part))
            elif part[0] == "value":
                said.append(F.coalesce(known[part[1]].cast("string"), F.lit("")))
            elif part[0] == "if":
                said.append(F.when(known[part[1]], text(part[2], known)).otherwise(text(part[3], known)))
            else:
                said.append(F.array_join(F.transform(known[part[2]], each(part, known)), ""))
        return F.concat(*said)

    def each(part: tuple, known: dict[str, Column]):
        return lambda x: text(part[3], known | {part[1]: x})

    return text(parse(template), values)


def read_templates(folder: str) -> dict[str, str]:
    """Templates of all ``*.yaml`` files below a folder, by their ``name`` (the file's without one).

    Understood are lines ``key: value``, quoted or not, and blocks after ``key: |``; the text is under ``template``.
    """
    found = {}
    for path in sorted(Path(folder).rglob("*.yaml")):
        keys: dict[str, str] = {}
        lines = path.read_text(encoding="utf-8").split("\n")
        i = 0
        while i < len(lines):
            m = re.match(r"(\w+):\s*(.*?)\s*$", lines[i])
            i += 1
            if not m:
                continue
            key, value = m.groups()
            if value in ("|", "|-"):
                body = []
                while i < len(lines) and (not lines[i].strip() or lines[i][0] == " "):
                    body.append(lines[i])
                    i += 1
                indent = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
                value = "\n".join(x[indent:] for x in body).rstrip("\n") + ("\n" if value == "|" else "")
            elif len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            keys[key] = value
        found[keys.get("name", path.stem)] = keys.get("template", "")
    return found


def fingerprint(templates: dict[str, str]) -> str:
    """Eight hex digits over the recognition templates in order of name."""
    return hashlib.sha1("".join(templates[k] for k in sorted(templates)).encode()).hexdigest()[:8]
