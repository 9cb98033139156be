"""What a pattern cannot match without: words that an index of texts can look up, and pieces of text."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: An edge of a word, and a place where the pattern may take letters that it does not name.
EDGE, OPEN = "edge", "open"


def _is_word(c: int) -> bool:
    return c < 128 and (chr(c).isalnum() or chr(c) == "_")


def _atoms(parsed) -> list:
    """A pattern as characters, edges and open places; a list stands for a part that may be left out."""
    out: list = []
    for op, arg in parsed:
        if op is K.LITERAL:
            out.append(chr(arg).lower() if _is_word(arg) else EDGE)
        elif op is K.AT:
            out.append(EDGE)
        elif op is K.SUBPATTERN:
            out += _atoms(arg[3])
        elif op is K.IN and all(o is K.CATEGORY and a is K.CATEGORY_SPACE or o is K.LITERAL and not _is_word(a) for o, a in arg):
            out.append(EDGE)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            part = _atoms(inner)
            if low >= 1 and all(x == EDGE for x in part):
                out.append(EDGE)
            elif low == 1 == high:
                out += part
            elif low == 0:
                out.append(part)
            else:
                out += [*part, OPEN]
        elif op is K.BRANCH:
            out.append(OPEN)
        else:
            out.append(OPEN)
    return out


def _runs(atoms: list) -> list[tuple[str, bool]]:
    """Runs of letters and digits that every match holds, and whether each is certain to be a word of its own."""
    found, run, edge, whole = [], "", False, False
    for x in [*atoms, OPEN]:
        if isinstance(x, str) and len(x) == 1:
            whole = whole if run else edge
            run, edge = run + x, False
            continue
        if run:
            found.append((run, whole and x == EDGE))
            run = ""
        # A part that may be left out keeps an edge only if it ends in one itself.
        edge = edge and bool(x) and x[-1] == EDGE if isinstance(x, list) else x == EDGE
    return found


def _alternatives(pattern: str) -> list[list]:
    """The pattern once for each alternative of its first choice."""
    parsed = list(_parser.parse(pattern, re.IGNORECASE))
    for i, (op, arg) in enumerate(parsed):
        inner = list(arg[3]) if op is K.SUBPATTERN else [(op, arg)]
        if len(inner) == 1 and inner[0][0] is K.BRANCH:
            return [[*parsed[:i], *branch, *parsed[i + 1 :]] for branch in inner[0][1][1]]
    return [parsed]


def _required(pattern: str, whole: bool) -> list[str]:
    out = []
    for branch in _alternatives(pattern):
        runs = [run for run, sure in _runs(_atoms(branch)) if sure or not whole]
        if not runs:
            return []
        out.append(max(runs, key=len))
    return sorted(set(out))


def required_words(pattern: str) -> list[str]:
    """Lower-case words of which every match holds one; empty where that can't be told.

    A word counts only if the pattern shows edges on both of its sides, so
    that it stands in the text as a word of its own; of several, the longest
    is taken. Alternatives at the top of the pattern give a word each.
    """
    return _required(pattern, whole=True)


def required_texts(pattern: str) -> list[str]:
    """Lower-case texts of which every match holds one, inside words or not; empty where that can't be told."""
    return _required(pattern, whole=False)
