"""Operator 5: BPE encoding by backtracking, decoding by an offset table.

``WordBpe`` reads a word-level BPE file (byte alphabet, end-of-word suffix,
lower case) and gives the ids that merging by rank gives, without merging: an
Aho-Corasick automaton finds every token at every position of a word, the
longest is tried first, and a pair-compatibility table tells whether two
neighbouring tokens can stand side by side in a merged word. A position from
which no token leads on is marked and never tried again, so a word costs time
in proportion to its length.

Results for odd rows: a null or empty text has no ids, the empty decimal list
and the empty decoded text; repeated rows are encoded each; texts of any length
are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_rows, text_slices

#: Words in a generation of an encoder's cache (about 200 bytes each), and of other caches.
ENCODED_WORDS = 600_000
CACHE_WORDS = 250_000
#: Longer words are seldom met again and would fill the cache.
LONG_WORD = 128
NO_RANK = 1 << 40

#: Fixed value of the tokenizer format: its split pattern.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts outside Latin-1, or with what may be a special token.
ODD = "[^\\x{00}-\\x{ff}]|<\\|"
#: What stands between words of letters, in the order of the split pattern.
CUT = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \x{85}\x{a0}\p{L}\p{N}]+)"
PLAIN_WORD = re.compile("[a-z\xdf-\xf6\xf8-\xff]+\\Z")


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte, from the rule of byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, others for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def library_rules():
    from tokenizers import Regex, normalizers, pre_tokenizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(SPLIT.pattern), "removed", invert=True)


def newer_words(text: str) -> list[str]:
    """The words of a text with characters that Python's Unicode tables lack:
    the tokenizer library's own tables decide which of them are letters."""
    rules, split = library_rules()
    return [w for w, _ in split.pre_tokenize_str(rules.normalize_str(text))]


def distinct_pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces between blanks of all texts end to end, dictionary-encoded, and where each text ends."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy()
    return lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode(), bounds[1:] - bounds[0]


class Words(dict):
    """A cache that computes what it lacks. A full cache becomes the old
    generation, from which words in use are taken over; so memory is bounded
    and frequent words stay. Words of over LONG_WORD characters are not kept."""

    def __init__(self, compute, limit: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > LONG_WORD:
            return self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def many(self, keys: list, compute_all) -> list:
        """The values of many keys; those that are lacking are computed together."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        lacking = [k for k in keys if k not in self]
        old = self.old
        self.update((k, old[k]) for k in lacking if k in old)
        lacking = list(dict.fromkeys(k for k in lacking if k not in old))
        made = dict(zip(lacking, compute_all(lacking), strict=True))
        self.update((k, v) for k, v in made.items() if len(k) <= LONG_WORD)
        return [made[k] if k in made else self[k] for k in keys]


class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str, cache: int = ENCODED_WORDS):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        letters = byte_letters()
        self.names: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        # A word is a string over 512 symbols: byte b, or 256 + b where the word ends.
        symbols: dict[int, str] = {}
        for letter, b in letters.items():
            symbols[vocab[letter]] = chr(b)
            symbols[vocab[letter + suffix]] = chr(256 + b)
        size = max(self.names) + 1
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [NO_RANK] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            name = self.names[a] + self.names[b]
            made = vocab[name]
            symbols[made] = symbols[a] + symbols[b]
            self.parts[made], self.rank[made], self.pairs[a, b] = (a, b), rank, rank
        self.ends = Words(self._spines, 1 << 17)
        self.width = [0] * size
        self.automaton = ahocorasick.Automaton()
        whole = set()  # tokens whose own text merges to them; others never come up
        for i, s in symbols.items():
            self.width[i] = len(s)
            if i not in self.parts or (self.parts[i][0] in whole and self.parts[i][1] in whole and self._border_lasts(*self.parts[i], full=False)):
                whole.add(i)
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        by_text = {symbols[i]: i for i in whole}
        self.widths = np.array(self.width, np.int64)
        #: The longest token that is a proper prefix of each token; -1 if there is none.
        self.shorter = [-1] * size
        for s, i in by_text.items():
            self.shorter[i] = next((by_text[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_text), -1)

        # Decoding: each token and the blank after it lie in one block, at known offsets.
        self.token_block = OffsetTable([(self.names.get(i, "") + " ").encode() for i in range(size)])
        self.number_block = OffsetTable([f"{i} ".encode() for i in range(size)])

        self.fits = Words(self._compatible, 1 << 20)
        self.words = Words(self._encode_word, min(cache, CACHE_WORDS))
        self.chunks = Words(self._encode_chunk, min(cache, CACHE_WORDS))
        self.plain = Words(None, cache)

    # -- pair compatibility -------------------------------------------------

    def _spines(self, token: int) -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
        """The tokens at a token's right and left edge, smallest first, and the
        rank at which each grows into the next."""
        out = []
        for side in (1, 0):
            edge = [token]
            while edge[-1] in self.parts:
                edge.append(self.parts[edge[-1]][side])
            out.append((edge[::-1], [*(self.rank[t] for t in edge[-2::-1]), NO_RANK]))
        return out[0], out[1]

    def _compatible(self, pair: int) -> bool:
        """Whether merging leaves the border between two tokens alone. pair: left << 16 | right."""
        return self._border_lasts(pair >> 16, pair & 0xFFFF, full=True)

    def _border_lasts(self, left: int, right: int, full: bool) -> bool:
        """Whether the border lasts until both tokens are whole, and (``full``) beyond.

        Both edges grow in order of rank; the border would vanish if at some
        time the two edge tokens form a merge of a lower rank than the next
        growth on either side (of equal ranks the leftmost merge comes first).
        """
        a, grow_a = self.ends[left][0]
        b, grow_b = self.ends[right][1]
        i = j = 0
        find = self.pairs.get
        while True:
            x, y = grow_a[i], grow_b[j]
            border = find((a[i], b[j]))
            if x <= y:
                if x == NO_RANK:
                    return not full or border is None
                if border is not None and border < x:
                    return False
                i += 1
            else:
                if border is not None and border <= y:
                    return False
                j += 1

    # -- encoding -----------------------------------------------------------

    def _encode_word(self, word: str) -> bytes:
        return self._encode_words([word])[0]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of many words, each as bytes of int32.

        The automaton runs once over all words end to end: no token reaches over
        a word's last symbol. Words whose longest tokens all fit their neighbours
        are done; the others go on one by one.
        """
        if not words:
            return []
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype("<u4")
        symbols[ends - 1] += 256
        text = symbols.tobytes().decode("utf-32-le")
        tokens = np.array([t for _, t in self.automaton.iter_long(text)], np.int64)
        owner = np.searchsorted(ends, np.cumsum(self.widths[tokens]))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inner] << 16 | tokens[inner + 1], return_inverse=True)
        fit = np.fromiter(map(self.fits.__getitem__, pairs.tolist()), bool, len(pairs))
        last = np.cumsum(np.bincount(owner, minlength=len(words)))
        bounds, data = [0, *(last * 4).tolist()], tokens.astype("<i4").tobytes()
        out = [data[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905, RUF007
        for i in np.unique(owner[inner[~fit[which]]]).tolist():
            out[i] = self._shorten(text[ends[i] - len(raw[i]) : ends[i]], tokens[bounds[i] // 4 : bounds[i + 1] // 4].tolist())
        return out

    def _shorten(self, text: str, greedy: list[int]) -> bytes:
        """One word from its longest tokens: where one does not fit the token before,
        the next shorter one is tried; where none does, the token before is shortened."""
        width, fits, shorter, find = self.width, self.fits, self.shorter, self.automaton.iter_long
        longest, n = {}, 0
        for token in greedy:
            longest[n] = token
            n += width[token]
        tokens, closed, pos, last = [], set(), 0, -1
        while pos < n:
            token = longest.get(pos)
            if token is None:
                token = longest[pos] = next(find(text, pos))[1]
            while True:
                if token >= 0:
                    if pos + width[token] not in closed and (last < 0 or fits[last << 16 | token]):
                        break
                    token = shorter[token]
                else:
                    closed.add(pos)
                    token = tokens.pop()
                    pos -= width[token]
                    token, last = shorter[token], tokens[-1] if tokens else -1
            tokens.append(token)
            pos += width[token]
            last = token
        return array("i", tokens).tobytes()

    def _encode_plain(self, text: str) -> bytes:
        """Normalise, split and encode a text without special tokens or blanks."""
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in text):
                return b"".join([self.words[w] for w in newer_words(text)])
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one
        text = text.lower()
        if PLAIN_WORD.match(text):
            return self.words[text]
        return b"".join([self.words[w] for w in SPLIT.findall(text)])

    def _encode_lowered(self, pieces: list[str]) -> list[bytes]:
        """The same for many pieces of lowered Latin-1 text."""
        words, counts = [], []
        for piece in pieces:
            own = [piece] if PLAIN_WORD.match(piece) else SPLIT.findall(piece)
            words += own
            counts.append(len(own))
        done, at, out = self._encode_words(words), 0, []
        for n in counts:
            out.append(done[at] if n == 1 else b"".join(done[at : at + n]))
            at += n
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        if self.special_split is not None and "<|" in chunk:
            parts = self.special_split.split(chunk)
            return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self._encode_plain(p) for p in parts if p)
        return self._encode_plain(chunk)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (int32)."""
        return self.encode_column(pa.array([text]))[0]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column end to end, and where each text ends.

        No token reaches over white space, so each distinct piece between
        blanks is looked up once and its ids are copied to its places. Latin-1
        texts are lowered and cut into words beforehand, which leaves fewer
        distinct pieces; other texts are normalised piece by piece.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_pieces(texts, self._tables_of_latin)
        mask = pa.array(odd)
        simple = self.encode_column(texts.filter(pc.invert(mask)))
        other = self._encode_pieces(texts.filter(mask), lambda d: OffsetTable(list(map(self.chunks.__getitem__, d.to_pylist())), np.int32))
        sizes, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for own, (ids, ends), base in ((~odd, simple, 0), (odd, other, len(simple[0]))):
            sizes[own] = np.diff(ends, prepend=0)
            starts[own] = ends - sizes[own] + base
        return OffsetTable.over(np.concatenate([simple[0], other[0]]), starts, sizes).join(np.arange(len(texts)))

    def _encode_pieces(self, texts: pa.Array, table_of) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the distinct pieces between blanks; ``table_of`` gives theirs."""
        pieces, ends = distinct_pieces(texts)
        ids, upto = table_of(pieces.dictionary).join(pieces.indices.to_numpy())
        return ids, np.concatenate([[0], upto])[ends]

    def _tables_of_latin(self, pieces: pa.Array) -> OffsetTable:
        """Distinct pieces are lowered and cut into words, and distinct words encoded."""
        words, ends = distinct_pieces(pc.replace_substring_regex(pc.utf8_lower(pieces), CUT, r" \1 "))
        table = OffsetTable(self.plain.many(words.dictionary.to_pylist(), self._encode_lowered), np.int32)
        ids, upto = table.join(words.indices.to_numpy())
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], ends])]
        return OffsetTable.over(ids, bounds[:-1], np.diff(bounds))

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        return self.token_block.join(ids)[0][:-1].tobytes().decode()


class OffsetTable:
    """Byte strings laid end to end, with their offsets; ``join`` copies the
    strings of many numbers at once."""

    def __init__(self, items: list[bytes], kind=np.uint8):
        self.block = np.frombuffer(b"".join(items), kind)
        self.sizes = np.fromiter(map(len, items), np.int64, len(items)) // np.dtype(kind).itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def over(cls, block: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> OffsetTable:
        own = cls.__new__(cls)
        own.block, own.starts, own.sizes = block, starts, sizes
        return own

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined items, and where each ends in them."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return self.block[:0], ends
        return self.block[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + sizes, sizes)], ends


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder for each Python worker and file."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bpe = load(path)
    for batch in text_slices(batches):
        ids, last = bpe.encode_column(batch.column(1))
        sums = []
        for table in (bpe.number_block, bpe.token_block):
            data, ends = table.join(ids)
            bound = [0, *np.concatenate([[0], ends])[last].tolist()]
            view = memoryview(np.ascontiguousarray(data))
            sums.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(bound, bound[1:])])  # noqa: B905, RUF007
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(last, prepend=0)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each row."""
    path = path or default_path()
    return text_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        lambda batches: encode_batches(batches, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
