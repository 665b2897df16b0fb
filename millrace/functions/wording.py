"""Phrases written as plain words, made into patterns."""

from __future__ import annotations

import re


def forms(*phrases: str) -> str:
    """A pattern, for any case, of phrases of words: a/b is either word, _ a space inside one of them, (x) a word
    that may be missing, and ~ at its end any ending of a word."""

    def word(w: str) -> str:
        ways = [re.escape(x).replace("_", r"\s+").replace(r"\~", "~").replace("~", r"\w+") for x in w.split("/")]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    def phrase(p: str) -> str:
        out = ""
        for w in p.split():
            out += rf"(?:{word(w[1:-1])}\s+)?" if w.startswith("(") else word(w) + r"\s+"
        return out.removesuffix(r"\s+")

    return rf"(?i)\b(?:{'|'.join(phrase(p) for p in phrases)})\b"


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of one of some words or signs as they stand, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
