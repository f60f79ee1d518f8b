"""Byte-pair encoding of a public vocabulary: speculate, verify, and merge exactly only where that fails.

For each new word a greedy longest match proposes tokens. A sequence is what the
merges give if and only if every adjacent pair is compatible, that is, if merging
the pair's own text gives just that pair; a single token has to give itself. Pairs
of a whole batch are tested together against what is known already. Words with a
failing pair are merged step by step, lowest rank first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import slices, tidy
from quillstream.llm.shared import project

#: Words that a task remembers; longer words are encoded each time.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 48
#: Pairs whose compatibility a task remembers.
REMEMBERED_PAIRS = 1_000_000
#: Bytes of text whose new words are encoded together.
SLICE = 2 << 20

#: Letters and numbers that came after version 16 of Unicode, which the tokenizer files' patterns mean.
LATER = (
    "0558 058b-058c 088f 0c5c 0cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10d50-10d65 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 "
    "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Capitals of versions 16 and 17 of Unicode and how far their small letters lie from them.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
SMALL = {c: c + step for first, last, step in LATER_CAPITALS for c in range(first, last + 1)}


def later_class() -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in LATER.split())


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file whose words end in a suffix."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(split)
        # a sign of a later version is neither letter nor number here, so it is one of the other signs
        later = later_class()
        self.capital = regex.compile(f"[{''.join(map(chr, SMALL))}]")
        self.rare = regex.compile(split.replace("[\\p{L}]", f"[\\p{{L}}--[{later}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{later}]]").replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{later}])"), regex.V1)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.longest = max(map(len, self.vocab))
        self.known: dict[str, list[int]] = {}
        self.good = np.zeros(0, np.int64)  # compatible pairs, sorted; a single token is paired with itself plus a mark
        self.bad = np.zeros(0, np.int64)

    @classmethod
    def load(cls, text: str) -> WordBpe:
        return cls(json.loads(text))

    def merge(self, word: str) -> list[int]:
        """Exact merging of a word in byte characters."""
        return self.merge_ids([self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]])

    def merge_ids(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            if found := self.rank.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i] = self.rank[left, right][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := self.rank.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, ids[a], ids[b]))
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over a word in byte characters, the suffix at its end; None where no token fits."""
        out, at, n = [], 0, len(word)
        vocab, longest, suffix = self.vocab, self.longest, self.suffix
        while at < n:
            if n - at <= longest and (token := vocab.get(word[at:] + suffix)) is not None:
                out.append(token)
                return out
            for end in range(min(n - 1, at + longest), at, -1):
                if (token := vocab.get(word[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
            else:
                return None
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For keys first * 2^31 + second, whether merging the pair's text gives the pair; second is 2^31 - 1 for none."""
        out = np.zeros(len(keys), bool)
        unknown = np.ones(len(keys), bool)
        for table, value in ((self.good, True), (self.bad, False)):
            if len(table):
                at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[at] == keys
                out[hit] = value
                unknown &= ~hit
        if unknown.any():
            new = np.unique(keys[unknown])
            yes = np.array([self._gives_itself(int(k) >> 31, int(k) & 0x7FFFFFFF) for k in new], bool)
            self.good = np.union1d(self.good, new[yes])
            self.bad = np.union1d(self.bad, new[~yes])
            out[unknown] = np.isin(keys[unknown], new[yes])
        return out

    def _gives_itself(self, first: int, second: int) -> bool:
        ids = [first] if second == 0x7FFFFFFF else [first, second]
        return self.merge_ids(self._symbols("".join(self.tokens[t] for t in ids))) == ids

    def _symbols(self, text: str) -> list[int]:
        ended = bool(self.suffix) and text.endswith(self.suffix)
        body = list(text[: len(text) - len(self.suffix)] if ended else text)
        if ended:
            body[-1] += self.suffix
        return [self.vocab[c] for c in body]

    def learn(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encode new words together."""
        words = list(words)
        shaped = [w.encode().decode("latin-1").translate(self.table) for w in words]
        proposed = [self.propose(w) for w in shaped]
        ok = [p is not None for p in proposed]
        size = np.array([len(p) if p else 0 for p in proposed], np.int64)
        flat = np.array([t for p in proposed if p for t in p], np.int64)
        if len(flat):
            owner = np.repeat(np.arange(len(words)), size)
            end = np.cumsum(size)[owner] - 1 == np.arange(len(flat))
            nxt = np.append(flat[1:], 0)
            alone = size[owner] == 1
            keys = np.where(end, np.int64(0x7FFFFFFF), nxt) | flat << 31
            test = ~end | alone
            passed = np.ones(len(flat), bool)
            passed[test] = self.compatible(keys[test])
            failed = np.zeros(len(words), bool)
            failed[owner[~passed]] = True
            ok = [o and not f for o, f in zip(ok, failed.tolist(), strict=True)]
        return {w: p if o else self.merge(s) for w, s, p, o in zip(words, shaped, proposed, ok, strict=True)}

    def pieces(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-casing letter by letter knows no final sigma
            text = text.replace("Σ", "σ")
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.rare.findall(text.translate(SMALL) if self.capital.search(text) else text)
        return self.word.findall(text)

    def parts(self, text: str) -> list[list[str] | int]:
        """Words between special tokens, and the ids of those."""
        if self.special is None or "<|" not in text and not self.special.search(text):
            return [self.pieces(text)]
        out: list[list[str] | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += [self.pieces(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return [*out, self.pieces(text[at:])]

    def encode_batch(self, texts: Iterable[str]) -> Iterator[array]:
        split = [self.parts(t) for t in texts]
        seen: set[str] = set()
        for parts in split:
            for part in parts:
                if not isinstance(part, int):
                    seen.update(part)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.good) + len(self.bad) > REMEMBERED_PAIRS:
            self.good, self.bad = self.good[:0], self.bad[:0]
        known = self.known
        new = self.learn(w for w in seen if w not in known)
        known.update((w, t) for w, t in new.items() if len(w) <= REMEMBERED_LENGTH)
        look = {w: t for w, t in new.items() if len(w) > REMEMBERED_LENGTH}
        for parts in split:
            ids = array("I")
            for part in parts:
                if isinstance(part, int):
                    ids.append(part)
                elif look:
                    for w in part:
                        ids.extend(known.get(w) or look[w])
                else:
                    for w in part:
                        ids.extend(known[w])
            yield ids

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@cache
def loaded(text: str) -> WordBpe:
    return WordBpe.load(text)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one for each document.

    `vocabulary` is the path of a tokenizer file; its text is broadcast, a fixed size
    of some megabytes. A null text is an empty one, which has no tokens; ids of no
    tokens and their text digest as empty bytes. Texts are encoded whole. A null
    doc_id is kept, repeated rows are encoded alike, an empty table gives no rows.
    """
    with open(vocabulary, encoding="utf-8") as source:
        spec = docs.sparkSession.sparkContext.broadcast(source.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(spec.value)
        for batch in batches:
            for at, part in slices(batch.column("text"), SLICE):
                count, ids_sha, text_sha = [], [], []
                for ids in coder.encode_batch(part.to_pylist()):
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if ids else b"").hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = project(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, ids): the token ids of each document."""
    with open(vocabulary, encoding="utf-8") as source:
        spec = docs.sparkSession.sparkContext.broadcast(source.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(spec.value)
        for batch in batches:
            for at, part in slices(batch.column("text"), SLICE):
                ids = pa.array([np.frombuffer(i, np.uint32).astype(np.int32) if i else [] for i in coder.encode_batch(part.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), ids], ["doc_id", "ids"])

    return project(docs, doc_id="bigint", text="string").mapInArrow(tidy(run), "doc_id bigint, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids)."""
    with open(vocabulary, encoding="utf-8") as source:
        spec = rows.sparkSession.sparkContext.broadcast(source.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(spec.value)
        for batch in batches:
            texts = pa.array([coder.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(tidy(run), "doc_id bigint, text string")
