"""Token counts by prefix dynamic programming over a word-end BPE vocabulary.

For every prefix of a word the table keeps the last token and the number of
tokens of its encoding.  The encoding of a prefix is the encoding of a shorter
prefix followed by one token, and exactly one such token is compatible with
the last token of the shorter prefix, so one pass over the word fills the
table.  Counts at text prefixes are sums of whole words plus one word prefix:
truncation and budget questions are answered from the tables alone.

Texts are normalised and cut into words as the library does it.  Where all
characters are in ``_PLAIN``, Python's tables say the same as the library's;
other texts go through the library's own normaliser and splitter, because
Unicode tables of different versions disagree on rare characters.

Nulls count as empty texts (0 bytes, 0 tokens); texts are never cut, rows are
never merged, so repeated rows and ids give repeated result rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm._io import Batches, arrow_schema, batch, columns

#: Bytes of the words kept in a worker's cache before it is emptied; bounds memory, never results.
CACHE_BYTES = 64 << 20
#: What an entry takes beside its word.
_ENTRY = 160
#: Characters on whose case, composition and class all versions of Unicode agree.
_PLAIN = "\\x00-\u024f\u2010-\u2026\u20ac"
_END = "</w>"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}


class PrefixCounter:
    """Exact token counts at every prefix for a tokenizer file with word ends."""

    def __init__(self, source: str):
        """From the text of a tokenizer file."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError("a BPE file with word ends is needed")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain_pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.rare = regex.compile(f"[^{_PLAIN}]").search
        self.normalizer = Tokenizer.from_str(source).normalizer
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.vocab = frozenset(model["vocab"])
        self.closing = frozenset(t[: -len(_END)] for t in self.vocab if t.endswith(_END))
        self.longest = max(map(len, self.closing))
        self.begins = frozenset(t[:k] for t in self.vocab for k in range(1, len(t) + 1))
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b, i))
        self.alphabet = _byte_alphabet()
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, int] = {}
        self.cached = 0

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """Outermost symbols of a token on one side while it is built, each with the rank of the merge that absorbs it."""
        out, absorbed = [], float("inf")
        while True:
            out.append((token, absorbed))
            made = self.parts.get(token)
            if made is None:
                return out
            token, absorbed = made[side], made[2]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` followed by ``right`` is encoded as just these two tokens."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            rights = self._spine(right, 0)
            known = not any(
                (r := self.rank.get((a, b))) is not None and r < gone_a and r <= gone_b for a, gone_a in self._spine(left, 1) for b, gone_b in rights
            )
            self.fits[left, right] = known
        return known

    def _open(self, s: str, upto: int) -> tuple[list[str], list[int]]:
        """Last token and token count of every prefix of ``s`` without a word end.

        Works forwards: tokens that start where an encoded prefix ends are
        tried while they still begin some vocabulary entry.
        """
        last, count = [""] * (upto + 1), [0] * (upto + 1)
        vocab, begins, fits, ok = self.vocab, self.begins, self.fits, self.compatible
        for i in range(upto):
            before, n = last[i], count[i] + 1
            for j in range(i + 1, upto + 1):
                t = s[i:j]
                if t not in begins:
                    break
                if not count[j] and t in vocab:
                    if i:
                        fit = fits.get((before, t))
                        if not (ok(before, t) if fit is None else fit):
                            continue
                    last[j], count[j] = t, n
        return last, count

    def _closed(self, s: str, i: int, last: list[str], count: list[int]) -> int:
        for j in range(max(0, i - self.longest), i):
            t = s[j:i]
            if t in self.closing and (not j or self.compatible(last[j], t + _END)):
                return count[j] + 1
        raise ValueError(f"no encoding of {s[:i]!r}")

    def symbols(self, piece: str) -> str:
        return "".join(map(self.alphabet.__getitem__, piece.encode()))

    def word(self, piece: str) -> int:
        """Tokens of one whole word."""
        n = self.cache.get(piece)
        if n is None:
            s = self.symbols(piece)
            self.cached += 4 * len(piece) + _ENTRY
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 4 * len(piece) + _ENTRY
            n = self.cache[piece] = 1 if s in self.closing else self._closed(s, len(s), *self._open(s, len(s) - 1))
        return n

    def word_prefixes(self, piece: str) -> list[int]:
        """Tokens of every character prefix of a word, the empty one first."""
        s = self.symbols(piece)
        last, count = self._open(s, len(s))
        ends, at = [0], 0
        for c in piece:
            at += len(c.encode())
            ends.append(self._closed(s, at, last, count))
        return ends

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised."""
        if self.rare(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.plain_pieces((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def words(self, text: str) -> list[str | None]:
        """Words of a text in order, None for a special token."""
        if "<|" not in text:
            return self.pieces(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [*self.pieces(text[at : m.start()]), None]
            at = m.end()
        return out + self.pieces(text[at:])

    def count(self, text: str) -> int:
        get, word = self.cache.get, self.word
        total = 0
        for w in self.words(text):
            total += 1 if w is None else (get(w) or word(w))
        return total

    def cumulative(self, text: str) -> list[int]:
        """Tokens up to the end of each word: the prefix table at word ends."""
        out = [0]
        for w in self.words(text):
            out.append(out[-1] + (1 if w is None else self.word(w)))
        return out

    def truncate(self, text: str, budget: int) -> tuple[str, int]:
        """The longest run of leading words, and characters of the next, within ``budget`` tokens; and its tokens.

        Returned in normalised form, words joined by one space.
        """
        kept, used = [], 0
        for w in self.words(text):
            n = 1 if w is None else self.word(w)
            if used + n > budget:
                if w is not None:
                    inner = self.word_prefixes(w)
                    k = max(i for i in range(len(inner)) if used + inner[i] <= budget)
                    if k:
                        kept.append(w[:k])
                        used += inner[k]
                break
            kept.append(w if w is not None else self.special[0])
            used += n
        return " ".join(kept), used


@lru_cache(maxsize=2)
def counter(source: str) -> PrefixCounter:
    return PrefixCounter(source)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), n_tokens=pa.int64(), over_limit=pa.bool_())


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Bytes, tokens and whether a text is over ``limit`` tokens, a row for each row of ``docs(doc_id, text)``.

    One scan without a shuffle.  ``path`` is read on the driver; the file, whose
    size a vocabulary bounds, is broadcast and every worker reads it once.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Batches) -> Batches:
        table = counter(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [table.count(t) for t in texts]
            yield batch(_ARROW, doc_id=b.column("doc_id"), n_bytes=[len(t) if t.isascii() else len(t.encode()) for t in texts], n_tokens=n, over_limit=[k > limit for k in n])

    return columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
