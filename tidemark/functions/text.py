"""Text expressions: cleaning, ordered tokens, glued words, escapes; and the segmentation of words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_word(text: Column) -> Column:
    """Lower case, typographic apostrophe and ligatures resolved, only a-z, German letters, apostrophes, hyphens and spaces kept, ends trimmed."""
    out = F.lower(text)
    for a, b in (("’", "'"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(out, "[^a-zäöüß'\\- ]", ""), F.lit("-' "))


def ordered_tokens(text: Column, tokens: Sequence[str]) -> Column:
    """Array of tokens, at each place the first of the list that fits (give longer ones first); characters that none fits are skipped."""
    import re

    return F.regexp_extract_all(text, F.lit("(" + "|".join(map(re.escape, tokens)) + ")"), 1)


def split_glued(text: Column) -> Column:
    """Words that punctuation glues become two (``say;"throw``: ``say throw``); nothing left becomes ``ah``."""
    out = F.trim(F.regexp_replace(text, "(?U)(?<=[^\\W\\d_])[;:,.!?\"“”]+(?=[^\\W\\d_])", " "))
    return F.when(out == "", "ah").otherwise(out)


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def file_title(title: Column, stem: Column) -> Column:
    """Title as a file name (letters, digits, underscores, hyphens, spaces), else the stem."""
    kept = F.trim(F.regexp_replace(title, "(?U)[^\\w\\- ]", ""))
    return F.when(kept != "", kept).otherwise(stem)


def track_label(name: Column) -> Column:
    """A part's name as the label of its track: only letters, digits and underscores; the name itself if none is left; Tutti for null."""
    kept = F.regexp_replace(name, "(?U)[^\\w]", "")
    return F.when(name.isNull(), "Tutti").when(kept != "", kept).otherwise(name)


def verse_of_pass(lyrics: Column, number: Column) -> Column:
    """Of a map verse -> text: the verse of the pass; a later pass without one takes the last verse there is; else the first."""
    exact = F.try_element_at(lyrics, number)
    last = F.try_element_at(lyrics, F.array_max(F.map_keys(lyrics)))
    return F.coalesce(exact, F.when(number > 1, last), F.try_element_at(lyrics, F.lit(1)))


def abbreviates(short: Column, full: Column) -> Column:
    """Whether ``T.`` stands for ``Tenor``, ``S.1`` for ``Soprano 1``: the same number of parts between slashes; of each the letters start those of
    the other, whatever their case, and the digits are equal. A part without letters stands for nothing."""
    letters = "A-Za-zÄÖÜäöü"

    def cut(parts: Column, pattern: str) -> Column:
        take = lambda p, k: F.regexp_extract(F.rtrim(F.trim(p), F.lit(".")) if k < 3 else F.trim(p), pattern, k if k < 3 else k - 2)
        plus = 0 if pattern.startswith("^([" + letters + "]+)") else 2
        return F.transform(parts, lambda p: F.struct(F.lower(take(p, 1 + plus)).alias("letters"), take(p, 2 + plus).alias("digits")))

    a = cut(F.split(short, "/"), f"^([{letters}]+)[.]?([0-9]*)$")
    b = cut(F.split(full, "/"), f"^([-{letters}]+)\\s*([0-9]*)$")
    fits = F.zip_with(a, b, lambda x, y: F.coalesce((x["letters"] != "") & F.startswith(y["letters"], x["letters"]) & (x["digits"] == y["digits"]), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(fits, lambda ok: ok)


def segment(parts: Sequence[str], is_word: Callable[[str], bool], longest: int | None = None) -> list[int]:
    """Ends of the fewest words that cover all parts; of equally few those whose last word starts first. Without a cover all parts are one word.
    ``longest``: the most parts that a word can have, if known; the work is in proportion to it."""
    fewest: list[tuple[int, int] | None] = [(0, -1)] + [None] * len(parts)
    for end in range(1, len(parts) + 1):
        options = [(fewest[i][0] + 1, i) for i in range(max(0, end - (longest or end)), end) if fewest[i] and is_word("".join(parts[i:end]))]
        fewest[end] = min(options, default=None)
    if not parts or not fewest[-1]:
        return [len(parts)] if parts else []
    ends, at = [], len(parts)
    while at > 0:
        ends.append(at)
        at = fewest[at][1]
    return ends[::-1]


def segment_column(parts: Column, words: frozenset[str]) -> Column:
    """``segment`` over an array column of parts that are not empty, in Arrow batches; the word list goes along with the task."""
    longest = max(map(len, words), default=1)

    @F.arrow_udf("array<int>")
    def run(column):
        import pyarrow as pa

        return pa.array([None if p is None else segment(p, words.__contains__, longest) for p in column.to_pylist()], pa.list_(pa.int32()))

    return run(parts)


def music_char(ch: Column) -> Column:
    """Private-use characters U+F020 to U+F0FF stand for Mac Roman bytes; others stay."""
    codes = range(0x20, 0x100)
    return F.translate(ch, "".join(chr(0xF000 + b) for b in codes), bytes(codes).decode("mac_roman"))


def known_tokens(phones: Column, table: dict[str, str]) -> Column:
    """The table's entries of an array of phones, in order; phones that it lacks are dropped."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return F.filter(F.transform(phones, lambda p: F.try_element_at(pairs, p)), lambda p: p.isNotNull())
