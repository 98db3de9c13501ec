"""Statistics of whole texts, shared by the quality operators."""

from __future__ import annotations

import re

import numpy as np

_SYMBOL = re.compile(r"[#*$%&|<>]")


def counts(text: str | None) -> dict[str, int]:
    """Over words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: none): n_words, word_chars (code points in words), n_symbols
    (characters of ``[#*$%&|<>]``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
    in windows of three words that the text has twice or more, the first included)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly these six characters
    n = len(words)
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    seen: set[bytes] = set()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    seen.update(lines)
    repeated = 0
    if n > 3:
        of: dict[bytes, int] = {}
        ids = np.array([of.setdefault(w, len(of)) for w in words], np.int64)
        pairs = ids[:-1] * len(of) + ids[1:]
        if len(of) < 1 << 20:
            triples = pairs[:-1] * len(of) + ids[2:]
        else:  # number the pairs first, so that the product stays small
            triples = np.unique(pairs[:-1], return_inverse=True)[1] * len(of) + ids[2:]
        order = np.argsort(triples, kind="stable")
        same = triples[order][1:] == triples[order][:-1]
        twice = np.zeros(len(triples), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            hit = np.zeros(n, bool)
            for k in range(3):
                hit[k : n - 2 + k] |= twice
            repeated = int(hit.sum())
    return {"n_words": n, "word_chars": len(text) - spaces, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": len(lines) - len(seen), "n_repeat_words": repeated}


#: Names of the statistics that the rule ensemble sees, all ratios or logarithms.
NAMES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "distinct_words", "upper", "digits", "ends", "marks", "line_words", "longest_word", "adjacent", "bang", "short_words", "spaces")


def vector(text: str | None) -> list[float]:
    """The statistics of a whole text; all defined for null and empty texts (zeros)."""
    c = counts(text)
    text = text or ""
    n, chars = c["n_words"], max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        c["word_chars"] / max(1, n),
        c["n_symbols"] / max(1, n),
        c["n_dup_lines"] / max(1, len(lines)),
        c["n_repeat_words"] / max(1, n),
        len(set(words)) / m,
        upper / m,
        sum(map(text.count, "0123456789")) / chars,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / max(1, len(lines)),
        (text.count(".") + text.count(",")) / m,
        float(np.log1p(m / max(1, len(lines)))),
        float(np.log1p(max(map(len, words), default=0))),
        sum(map(str.__eq__, words, words[1:])) / m,
        (text.count("!") + text.count("?")) / m,
        sum(len(w) < 2 for w in words) / m,
        text.count(" ") / chars,
    ]
