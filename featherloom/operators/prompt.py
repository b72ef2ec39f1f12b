"""What a language model is asked: earlier programs as versions, the columns, some rows."""

from __future__ import annotations

import ast
import random
from dataclasses import dataclass

from featherloom.operators.program import UnsupportedProgram, function_of

#: Fixed value: the name that programs have.
NAME = "modify_features"


def read_part(path: str) -> str:
    """A part of a prompt; a missing file is an empty one."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return ""


@dataclass(frozen=True)
class Frame:
    """What stands before and after the programs. {columns} and {rows} are filled in."""

    head: str = ""
    tail: str = ""

    def around(self, middle: str, columns: str, rows: str) -> str:
        parts = [x.replace("{columns}", columns).replace("{rows}", rows).strip("\n") for x in (self.head, self.tail)]
        return "\n\n".join(x for x in (parts[0], middle, parts[1]) if x) + "\n"


def as_version(source: str, k: int) -> str:
    """A program as version k; its text says which version it is to be better than."""
    fn = function_of(source)
    fn.name = f"{NAME}_v{k}"
    if fn.body and isinstance(fn.body[0], ast.Expr) and isinstance(fn.body[0].value, ast.Constant):
        fn.body = fn.body[1:]
    note = f"Version {k}." if k == 0 else f"Version {k}, which scores higher than {NAME}_v{k - 1}."
    fn.body = [ast.Expr(ast.Constant(note)), *(fn.body or [ast.Pass()])]
    return ast.unparse(ast.fix_missing_locations(fn))


def versions(parents: list[str]) -> str:
    """Parents, the worst first, as versions 0, 1, ..., and the header of the one that is asked for. Parents that can't be parsed are left out."""
    texts: list[str] = []
    for source in parents:
        try:
            texts.append(as_version(source, len(texts)))
        except UnsupportedProgram:
            continue
    k = len(texts)
    note = f"Version {k}, which is to score higher than {NAME}_v{k - 1}." if k else "The first version."
    return "\n\n\n".join([*texts, f'def {NAME}_v{k}(df_input):\n    """{note}"""'])


def render(parents: list[str], columns: str, rows: str, frames: list[Frame], rng: random.Random) -> str:
    """The prompt: one of the frames, drawn at even odds, around the versions."""
    return (rng.choice(frames) if frames else Frame()).around(versions(parents), columns, rows)
