"""BPE encoding and decoding with forced-boundary splitting.

For a vocabulary file of the "BPE with word ends" kind: NFC, lower case, white space dropped,
pieces split by a fixed pattern, bytes written as printable characters, the last one of a piece
carrying the word-end mark. Any two adjacent symbols that no vocabulary token holds side by side
can never be merged, so a cut between them is certain. Each piece falls into fragments at such
cuts, fragments are encoded independently, and their ids are concatenated. Word ends occur only
at the end of tokens, so the borders between pieces are forced cuts too.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import map_arrow

END = "</w>"
BITS = 32  # of a symbol in the number of a pair
LONG = 64  # symbols; longer fragments and pieces are merged by a heap, and not remembered
# Fixed values, which must equal the tokenizer file's: white space, and the pattern of pieces
# (letters first, which changes nothing: its branches differ in their first character).
SPACES = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"\p{{L}}+|\p{{N}}|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACES}\p{{L}}\p{{N}}]+")

# Where the library's Unicode tables are not those of Python and of the regex module.
# Code points that it does not take for letters or numbers (they were assigned later):
LATER = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
# Marks that it does not reorder when it normalises:
UNORDERED = (
    r"\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B-\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C\U00010D24-\U00010D27\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85"
    r"\U00011070\U0001133B\U0001145E\U00011839-\U0001183A\U0001193D-\U0001193E\U00011943\U000119E0\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44-\U00011D45\U00011D97\U00011F41-\U00011F42\U00016FF0-\U00016FF1"
    r"\U0001E08F\U0001E130-\U0001E136\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
# Capitals that it lower-cases and Python does not know yet, as (first, last, lower of the first):
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]

LOWER = {c: to + c - a for a, b, to in CAPITALS for c in range(a, b + 1)}
def _expanded(ranges: str) -> list[str]:
    """The characters of a text of escaped code points and ranges."""
    return [chr(c) for a, b in regex.findall("(.)(?:-(.))?", ranges.encode().decode("unicode_escape")) for c in range(ord(a), ord(b or a) + 1)]


#: A set: every text that is not ASCII is looked through, and a pattern of so many ranges tries them one by one.
RARE = frozenset(_expanded(LATER + UNORDERED)) | frozenset(map(chr, LOWER))
MARKS = regex.compile(f"([{UNORDERED}])")
RARE_PIECE = regex.compile(rf"(?:(?![{LATER}])\p{{L}})+|(?![{LATER}])\p{{N}}|'s|'t|'re|'ve|'m|'ll|'d|(?:[{LATER}]|[^{SPACES}\p{{L}}\p{{N}}])+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary, its merge ranks, and the symbol pairs that some token holds.

    Symbols are numbers: the id of those that are tokens, numbers above all ids for others. A pair
    is one number as well.
    """

    def __init__(self, spec: dict, remembered: int = 300_000):
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("not a BPE vocabulary with word ends")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.beyond = max(self.ids.values(), default=-1) + 1
        self.number: dict[str, int] = dict(self.ids)
        byte = byte_symbols()
        self.byte = [self._number(b) for b in byte]
        self.last_byte = [self._number(b + END) for b in byte]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {self._number(a) << BITS | self._number(b): i for i, (a, b) in enumerate(pairs)}
        self.merged = [self._number(a + b) for a, b in pairs]
        self.never = len(pairs)
        self.inside: set[int] = set()
        for token in self.ids:
            s = self._symbols(token)
            self.inside.update(a << BITS | b for a, b in zip(s, s[1:], strict=False))
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.most = remembered
        self.words: dict[str, tuple] = {}
        self.parts: dict[tuple, tuple[int, ...]] = {}

    def _number(self, symbol: str) -> int:
        return self.number.setdefault(symbol, self.beyond + len(self.number))

    def _symbols(self, token: str) -> list[int]:
        """The one-byte symbols of a token, the last one with its word end."""
        if token.endswith(END) and len(token) > len(END):
            return [self._number(c) for c in (*token[: -len(END) - 1], token[-len(END) - 1 :])]
        return [self._number(c) for c in token]

    def fragments(self, symbols: list[int]) -> list[tuple[int, ...]]:
        """Cut where two neighbours never stand inside one token."""
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False), 1) if a << BITS | b not in inside]
        if not cuts:
            return [tuple(symbols)]
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def encode_fragment(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        """Merge the leftmost pair of the lowest rank until no pair has one."""
        if len(fragment) > LONG:
            return self._encode_long(fragment)
        word, rank, never, merged = list(fragment), self.rank.get, self.never, self.merged
        ranks = [rank(a << BITS | b, never) for a, b in zip(word, word[1:], strict=False)]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            word[i] = new = merged[low]
            del word[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(word[i - 1] << BITS | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << BITS | word[i + 1], never)
        return tuple([w for w in word if w < self.beyond])

    def _encode_long(self, fragment: tuple[int, ...]) -> tuple[int, ...]:
        """The same in n log n steps: a heap of (rank, position) over a linked list of symbols."""
        n, rank, never = len(fragment), self.rank.get, self.never
        word: list[int | None] = list(fragment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        now = [rank(a << BITS | b, never) for a, b in zip(word, word[1:], strict=False)] + [never]  # of each position the rank of its pair
        heap = [r * n + i for i, r in enumerate(now) if r < never]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] != r:
                continue
            j = after[i]
            word[i] = self.merged[r]
            word[j], now[j] = None, never
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            now[i] = rank(word[i] << BITS | word[k], never) if k < n else never
            if now[i] < never:
                heapq.heappush(heap, now[i] * n + i)
            if (h := before[i]) >= 0:
                now[h] = rank(word[h] << BITS | word[i], never)
                if now[h] < never:
                    heapq.heappush(heap, now[h] * n + h)
        return tuple([w for w in word if w is not None and w < self.beyond])

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        symbols = [*map(self.byte.__getitem__, raw)]
        symbols[-1] = self.last_byte[raw[-1]]
        ids: list[int] = []
        for f in self.fragments(symbols):
            if (got := self.parts.get(f)) is None:
                if len(self.parts) >= self.most:
                    self.parts.clear()
                got = self.encode_fragment(f)
                if len(f) <= LONG:
                    self.parts[f] = got
            ids.extend(got)
        return tuple(ids)

    def word(self, piece: str) -> tuple[tuple[int, ...], str, str]:
        """(ids, the ids' decimals, the tokens decoded) of a piece, the two texts joined by blanks."""
        if (got := self.words.get(piece)) is None:
            if len(self.words) >= self.most:
                self.words.clear()
            ids = self.encode_piece(piece)
            got = ids, " ".join(map(str, ids)), self.decode(ids)
            if len(piece) <= LONG:
                self.words[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        """Normalise as the vocabulary file says, and split."""
        pattern = PIECE
        if not text.isascii():
            if not RARE.isdisjoint(text):
                pattern = RARE_PIECE
                text = "".join(unicodedata.normalize("NFC", x) for x in MARKS.split(text)).translate(LOWER)
            else:
                text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: no special rule for a final sigma
        return pattern.findall((text.replace("Σ", "σ") if "Σ" in text else text).lower())

    def words_of(self, text: str | None) -> list[tuple[tuple[int, ...], str, str]]:
        if not text:
            return []
        if self.split_special is None or "<|" not in text:
            pieces = self.pieces(text)
            found = list(map(self.words.get, pieces))
            return found if None not in found else [w or self.word(p) for w, p in zip(found, pieces, strict=True)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self.word(p) for p in self.pieces(text[at : m.start()])]
            i = self.special[m[0]]
            out.append(((i,), str(i), m[0]))
            at = m.end()
        return out + [self.word(p) for p in self.pieces(text[at:])]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, _, _ in self.words_of(text) for i in ids]

    def decode(self, ids) -> str:
        """The tokens joined by blanks, which is what a vocabulary without decoder asks for."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def load(path: str, **options) -> Bpe:
    with open(path, encoding="utf-8") as f:
        return Bpe(json.load(f), **options)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False, remembered: int = 300_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, and on demand ids (array<int>) and two digests.

    ids_sha256 is of the decimal ids joined by one blank, decoded_sha256 of the decoded text.
    path names a vocabulary file, read once on the driver (a few MB) and broadcast. Null and empty
    texts have no tokens. Repeated rows and null ids each keep their row; other columns are not
    read. An empty table gives no rows; of pairs with the lowest rank the leftmost merges first. Whole texts are encoded; a task remembers so many words, and as many fragments, at most;
    that alters its speed and memory, never a result.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * with_digests]
    schema = f"doc_id {kind}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(json.loads(shared.value), remembered)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                counts, ids, a, d = [], [], [], []
                for t in b.column(1):
                    own, decimals, decoded = zip(*words, strict=True) if (words := bpe.words_of(t.as_py())) else ((), (), ())
                    counts.append(sum(map(len, own)))
                    if with_ids:
                        ids.append([*chain.from_iterable(own)])
                    if with_digests:
                        a.append(sha(" ".join(decimals)))
                        d.append(sha(" ".join(decoded)))
                cols = [b.column(0), pa.array(counts, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                if with_digests:
                    cols += [pa.array(a, pa.string()), pa.array(d, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(docs.select(id_col, text_col), run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. A null list gives null, ids outside the vocabulary are left out."""
    with open(path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(json.loads(shared.value))
        for b in batches:
            texts = [None if (ids := x.as_py()) is None else bpe.decode(ids) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(id_col, ids_col), run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")
