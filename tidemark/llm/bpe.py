"""Byte-level BPE encoding by a walk over a trie of distinct words.

The encoding of a string of bytes has, for each of its prefixes, one last token. A token
can be the last one of a prefix if the prefix before it has a last token that stays next to it, that is, if
encoding the two tokens' bytes gives these two tokens again. So the last token of a trie node follows from those
of its ancestors, and words that share a prefix share the work: each node is settled once, parents first. A word's
encoding is read off backwards, from its node's last token to that of the prefix before it, and so on.

Texts are cut into words by the pattern of the vocabulary; before that, at single spaces between two non-space
characters, where the pattern always cuts. Both kinds of pieces are looked up in bounded caches first.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of a generation of a worker's caches, and the longest word that they keep: some 300 bytes an entry, whatever the texts.
CACHE_ENTRIES, LONGEST = 400_000, 64
#: Texts that are encoded at once: each distinct word of them is looked up once. On a core 10,000 texts took 5.5 s at 512 and at 1,024, 5.1 s at 2,048, 5.3 s at 4,096.
ENCODED_ROWS = 2048
#: Splits a text before the merges (the byte-level rule "use_regex").
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space but the space and the line feed, after Unicode and after str.isspace().
_OTHER = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def is_plain(text: str) -> bool:
    """Whether every space of a non-empty text stands between two non-space characters."""
    return not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _OTHER.search(text))


def chunks(texts: list[str]) -> Iterator[tuple[list[int], pa.Array]]:
    """Non-empty texts by position, and a list of pieces of each that give it when joined by spaces; cut at single spaces that stand between
    two non-space characters. Texts with other spaces come apart from those without."""
    plain = [i for i, t in enumerate(texts) if t and is_plain(t)]
    if plain:
        yield plain, pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    alone = set(plain)
    others = [i for i, t in enumerate(texts) if t and i not in alone]
    if others:
        yield others, pa.array([_CUT.split(texts[i]) for i in others], pa.list_(pa.large_string()))


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 for
    itself, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        byte_of = byte_alphabet()
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.id_of: dict[bytes, int] = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.id_of.items()}
        self.added: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]):
                raise ValueError(f"added token {t['content']!r} needs context that this encoder does not give")
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        #: Rank of the merge of two tokens; by token: rank of the merge that makes it (bytes: -1), and its two parts.
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.born = dict.fromkeys(self.bytes_of, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            t = ids[a + b]
            if self.born[t] < 0:
                self.born[t], self.parts[t] = r, (ids[a], ids[b])
            if max(self.born[ids[a]], self.born[ids[b]]) >= r or self.born[t] != r:
                raise ValueError("a merge comes before those that make its parts, or a token has two merges")

    @cached_property
    def final(self) -> dict[bytes, int]:
        """Tokens that their own bytes encode to; no other token is ever in an encoding."""
        final: dict[bytes, int] = {}
        ids: set[int] = set()
        for i, data in sorted(((i, d) for d, i in self.id_of.items()), key=lambda x: self.born[x[0]]):
            if i not in self.parts:
                ok = len(data) == 1
            else:
                left, right = self.parts[i]
                ok = left in ids and right in ids and self.side_by_side(left, right, self.born[i])
            if ok:
                final[data] = i
                ids.add(i)
        return final

    def side_by_side(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether no merge crosses the border of two tokens that stand side by side, up to a rank.

        Looks at the border backwards in time: the two tokens at it, when each was merged into the next, and whether
        their own merge comes before that. Of equal ranks the one further left comes first.
        """
        born, parts, rank = self.born, self.parts, self.rank
        x, y, x_ends, y_ends = left, right, until, until
        while True:
            r = rank.get((x, y))
            if r is not None and r < x_ends and r <= y_ends and r < until:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                x_ends, x = born[x], parts[x][1]
            else:
                y_ends, y = born[y], parts[y][0]


class Recent(dict):
    """A bounded cache in two generations; ``rotate`` makes the younger one the older one when it is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def look(self, key):
        """The value or None; what only the older generation has is taken into the younger one."""
        found = self.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self[key] = found
        return found

    def rotate(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class CachedEncoder:
    """Encodes whole texts by way of their distinct words. One instance serves a Python worker; its caches are bounded."""

    def __init__(self, vocabulary: Vocabulary, cache_entries: int = CACHE_ENTRIES):
        self.v = vocabulary
        self.limit = cache_entries
        self.pattern = regex.compile(PATTERN)
        #: Encodings of chunks with the space before them, so also of words that are a space and letters; of other words.
        self.chunks, self.words = Recent(cache_entries), Recent(cache_entries // 5)
        #: Longer words of the texts at hand: encoded like others, and forgotten with them.
        self.long: list[tuple[Recent, str]] = []
        names = sorted(map(re.escape, self.v.added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(names) + ")") if names else None
        of = self.v.bytes_of
        #: Bytes of each token.
        self.lengths = np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Encodings (ids as little-endian unsigned 32-bit integers) of distinct words."""
        raise NotImplementedError

    def _pieces(self, chunk: str, space: str) -> list[str | int]:
        """The words of a chunk by the pattern, and the ids of added tokens; ``space``: what stands before the chunk."""
        if chunk.isalpha():
            return [space + chunk]
        if (body := chunk[:-1]).isalpha():  # letters and one other character: the pattern always cuts between them
            return [space + body, chunk[-1]]
        words: list[str | int] = []
        for part in self.special.split(space + chunk) if self.special else [space + chunk]:
            if part in self.v.added:
                words.append(self.v.added[part])
            elif part:
                words += self.pattern.findall(part)
        return words

    def _place(self, word: str) -> tuple[Recent, str]:
        """The cache that holds a word, and its key there."""
        if word[0] == " " and (body := word[1:]).isalpha():
            return self.chunks, body
        return self.words, word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text as little-endian unsigned 32-bit integers; null and the empty text have none."""
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the caches are large
        try:
            self.chunks.rotate()
            self.words.rotate()
            out = [b""] * len(texts)
            for rows, cut in chunks(texts):
                for i, ids in zip(rows, self._encode_cut(cut), strict=True):
                    out[i] = ids
            return out
        finally:
            if collects:
                gc.enable()

    def _encode_cut(self, cut: pa.Array) -> list[bytes]:
        """Encodings of texts that are cut into chunks. Each distinct chunk is looked up once; the texts' ids are gathered from its ids."""
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        later = np.ones(len(at), bool)
        later[offsets[:-1]] = False
        firsts = [self._pieces(names[k], "") for k in at[offsets[:-1]].tolist()]
        at = at[later]
        used = np.zeros(len(names), bool)
        used[at] = True
        at = (np.cumsum(used) - 1)[at]
        names = [names[k] for k in np.flatnonzero(used).tolist()]
        found = self._encode_chunks(names, firsts)
        blob = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        ids = np.empty(ends[-1], "<u4")
        for i in range(0, len(at), 1 << 18):  # bounded working memory
            part = at[i : i + (1 << 18)]
            lo, hi = ends[i : i + len(part)], ends[i + len(part)]
            ids[lo[0] : hi] = blob[np.arange(lo[0], hi) + np.repeat(starts[part] - lo, sizes[part])]
        stops = ends[offsets - np.arange(len(offsets))].tolist()
        out = [self._joined(ws) + ids[a:b].tobytes() for ws, a, b in zip(firsts, stops, stops[1:], strict=False)]
        for cache, key in self.long:
            cache.pop(key, None)
        self.long.clear()
        return out

    def _encode_chunks(self, names: list[str], firsts: list[list[str | int]]) -> list[bytes]:
        """Encodings of distinct chunks with the space before them; the words of ``firsts`` are then in the caches too."""
        known, old, place = self.chunks, self.chunks.old, self._place
        found = [*map(known.get, names)]
        gaps = [k for k, ids in enumerate(found) if ids is None]
        letters, ended, split = {}, [], []  # bodies to encode after a space; chunks of a body and one other character; other chunks
        for k in gaps:
            c = names[k]
            if (ids := old.get(c)) is not None:
                known[c] = ids
            elif c.isalpha():
                letters[c] = None
            elif (body := c[:-1]).isalpha():
                if body not in known and known.look(body) is None:
                    letters[body] = None
                ended.append((c, body))
            else:
                split.append((c, self._pieces(c, " ")))
        words = {}
        for ws in [*firsts, sorted({c[-1] for c, _ in ended}), *(ws for _, ws in split)]:
            for w in ws:
                if type(w) is str and w not in words:
                    cache, key = place(w)
                    if cache is known and key in letters:
                        continue
                    if cache.look(key) is None:
                        words[w] = cache, key
        spaced = [" " + c for c in letters]
        if spaced or words:
            made = self.encode_words([*spaced, *words])
            known.update(zip(letters, map(made.__getitem__, spaced), strict=True))
            for w, (cache, key) in words.items():
                cache[key] = made[w]
                if len(key) > LONGEST:
                    self.long.append((cache, key))
        ends = self.words
        for c, body in ended:
            known[c] = known[body] + ends[c[-1]]
        for c, ws in split:
            known[c] = self._joined(ws)
        for k in gaps:
            found[k] = known[names[k]]
            if len(names[k]) > LONGEST:
                self.long.append((known, names[k]))
        self.long += [(known, body) for body in letters if len(body) > LONGEST]
        return found

    def _joined(self, words: list[str | int]) -> bytes:
        """The ids of words that are in the caches, and of added tokens."""
        parts = []
        for w in words:
            if type(w) is str:
                cache, key = self._place(w)
                parts.append(cache[key])
            else:
                parts.append(w.to_bytes(4, "little"))
        return b"".join(parts)


class TrieEncoder(CachedEncoder):
    """Encodes words by a walk over their trie, and decodes."""

    def __init__(self, vocabulary: Vocabulary, cache_entries: int = CACHE_ENTRIES):
        super().__init__(vocabulary, cache_entries)
        self.fits: dict[int, bool] = {}
        #: Suffix states: the longest end of the bytes so far that some token begins with, and the tokens that end there.
        self.begins = {d[:k] for d in vocabulary.final for k in range(1, len(d) + 1)}
        self.state_of: dict[bytes, int] = {b"": 0}
        self.strings: list[bytes] = [b""]
        self.tokens: list[list[tuple[int, int]]] = [[]]
        self.moves: dict[int, int] = {}
        of = self.v.bytes_of
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(of.get(i, b"") for i in range(max(of) + 1)), np.uint8)

    def _move(self, state: int, byte: int) -> int:
        """The suffix state after one more byte."""
        end = self.strings[state] + bytes([byte])
        while end not in self.begins:
            end = end[1:]
        after = self.state_of.get(end)
        if after is None:
            after = self.state_of[end] = len(self.strings)
            self.strings.append(end)
            final = self.v.final
            self.tokens.append([(len(end) - k, final[end[k:]]) for k in range(len(end)) if end[k:] in final])
        self.moves[state << 8 | byte] = after
        return after

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encodings (ids as little-endian unsigned 32-bit integers) of distinct words, by one walk over their trie.

        The trie is held as the sorted words: a word's path leaves that of the word before it where the two first
        differ, and the stacks have the states of the nodes on the present path. So the walk is depth first, enters
        every node once, and settles it from its ancestors.
        """
        moves, tokens, fits, move, side_by_side = self.moves, self.tokens, self.fits, self._move, self.v.side_by_side
        for known in (fits, moves):
            if len(known) > 4 * self.limit:
                known.clear()
        state, last, back = [0], [-1], [0]  # by depth: suffix state, last token of the prefix that ends there, where that token starts
        before = b""
        out = {}
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            n, depth = len(data), 0
            for x, y in zip(data, before, strict=False):
                if x != y:
                    break
                depth += 1
            del state[depth + 1 :], last[depth + 1 :], back[depth + 1 :]
            at = state[depth]
            for byte in data[depth:]:
                depth += 1
                if (after := moves.get(at << 8 | byte)) is None:
                    after = move(at, byte)
                at = after
                for size, token in tokens[at]:
                    if size == depth:
                        break
                    key = last[depth - size] << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = side_by_side(last[depth - size], token)
                    if ok:
                        break
                state.append(at)
                last.append(token)
                back.append(depth - size)
            before = data
            ids = []
            while n:
                ids.append(last[n])
                n = back[n]
            out[word] = b"".join([i.to_bytes(4, "little") for i in reversed(ids)])
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids (as ``encode`` gives them); bytes that are no UTF-8 become U+FFFD."""
        at = np.frombuffer(ids, "<u4")
        out = []
        for i in range(0, len(at), 1 << 16):  # bounded working memory
            part = at[i : i + (1 << 16)]
            n = self.lengths[part]
            total = np.cumsum(n)
            where = np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[part] - total + n, n)
            out.append(self.flat[where].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = CACHE_ENTRIES) -> TrieEncoder:
    """The encoder of this process."""
    return TrieEncoder(Vocabulary(path), cache_entries)


def encode_decode(df, path: str, id_column: str = "doc_id", text_column: str = "text", cache_entries: int = CACHE_ENTRIES):
    """Encode and decode every whole text: one row per input row, in no order, without a shuffle.

    Returns the id, ``n_tokens`` (long), ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded``.
    ``cache_entries`` bounds a worker's memory (some 600 bytes an entry) and changes no result.
    Null and empty texts have no tokens and decode to the empty text; repeated rows give repeated rows; further
    columns of the input are not carried.
    """
    from pyspark.sql import functions as F

    from .common import slices, small_batches

    def run(batches):
        enc = encoder(path, cache_entries)
        for batch in slices(batches, ENCODED_ROWS):
            ids = enc.encode(batch.column(1).to_pylist())
            n = [len(x) >> 2 for x in ids]
            decoded = [enc.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    rows = small_batches(df, ENCODED_ROWS).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_column)


def op3_bpe_trie(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole document, from the operator's ids and texts."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from .common import read

    done = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
