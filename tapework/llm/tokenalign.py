"""Alignment of the tokens that two tokenizers give a text, by interval coalescing.

Tokens are byte intervals. All A and B tokens are sorted by start; a running maximum of the ends tells
where a start reaches everything before it, and there a group ends (``coalesced``). Inside groups the
overlapping pairs are expanded (``overlaps``).

Both tokenizers treat a single space between two other characters as the start of a new token, so a
text is cut there into units, and a chunk of documents encodes and aligns each distinct unit once. A
unit's first byte is a boundary of both sides, so groups never cross units and the result is that of
the whole text, which the tests compare. Corpus-wide counts of linked id pairs go by way of the
chunks' dictionaries of pairs (``chunked``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapework.llm.chunked import cut, entries, packed, ranges, run_sums, starts_of, unpacked
from tapework.llm.common import prepare, stored

#: Where the tokenizer files are; read on the driver and sent to the tasks (some 3 MB).
FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

_SPACE = "▁"
#: White space other than spaces and newlines, and the mark that the B side has for a space.
_RARE = re.compile(rf"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000{_SPACE}]")
#: Single spaces that are next to none of these: only there may a text be cut.
_CUT = re.compile(rf"(?<=[^\s{_SPACE}]) (?=[^\s{_SPACE}])")
#: Characters that are encoded in one call.
_JOINED = 1 << 18
#: How byte-level vocabularies of this kind split a text before merging (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond Latin letters the classes of a character may depend on a library's Unicode version.
_LATIN = 0x250
#: (document, unit) pairs whose links are counted at once.
_SLICE = 1 << 20
_WIDTH = 1 << 32


# --- tokens ------------------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The two tokenizers, the bytes of their ids, and encoding without special tokens."""

    def __init__(self, a: str, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(piece)]
        self.fast = self._ranked(json.loads(a))
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Decimal ids with what follows them: ``,`` on the same side, ``|`` before the B side, ``;`` after a group.
        self.written = [f"{i}{end}" for end in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.rows = len(self.written) // 3
        self.written_size = np.array([len(x) for x in self.written], np.int64)

    def _ranked(self, model: dict):
        """The A vocabulary in an engine that merges by id, several times faster; None unless its merges
        come in the order of their ids, behind the plain splitting of byte-level vocabularies."""
        import tiktoken

        split, core = model.get("pre_tokenizer") or {}, model["model"]
        plain = (core["type"], split.get("type"), split.get("add_prefix_space"), split.get("use_regex"), model.get("normalizer"))
        made = [core["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in core.get("merges", ())]
        if plain != ("BPE", "ByteLevel", False, True, None) or made != list(range(256, len(core["vocab"]))):
            return None
        return tiktoken.Encoding("a", pat_str=_WORDS, special_tokens={}, mergeable_ranks={self.a_bytes[i]: i for i in core["vocab"].values()})

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space and ``text`` on both sides; None where the bytes differ from them."""
        if self.fast and (text.isascii() or ord(max(text)) < _LATIN):
            a = self.fast.encode_ordinary(" " + text)
        else:
            a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        true = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != true or b"".join(map(self.b_bytes.__getitem__, b)) != true:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def units(text: str) -> list[str]:
    """The pieces of ``text`` between single spaces that both tokenizers start a token with."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def _calls(names: list[str]) -> Iterator[tuple[np.ndarray, str]]:
    """Units to encode in one call, with their text: joined by spaces, those with odd ends alone, and
    those beyond Latin letters apart."""
    kinds: list[list[int]] = [[], [], []]
    for k, u in enumerate(names):
        odd = len(u.strip()) != len(u) or u[0] == _SPACE or u[-1] == _SPACE
        kinds[2 if odd else 0 if u.isascii() or ord(max(u)) < _LATIN else 1].append(k)
    for some in kinds[:2]:
        ks = np.array(some, np.int64)
        held = np.cumsum([len(names[k]) + 1 for k in some]) // _JOINED
        for part in np.split(ks, np.nonzero(np.diff(held))[0] + 1):
            if len(part):
                yield part, " ".join(map(names.__getitem__, part.tolist()))
    for k in kinds[2]:
        yield np.array([k]), names[k]


# --- alignment ---------------------------------------------------------------------------------

def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, A before B, and the group of each in that order: a group ends
    where a start reaches the largest end so far."""
    order = np.lexsort((side, start))
    top = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= top[:-1]
    return order, np.cumsum(fresh) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A token, B token) that share a byte; tokens of a side are in order and disjoint."""
    first = np.searchsorted(b_end, a_start, "right")
    size = np.maximum(np.searchsorted(b_start, a_end, "left") - first, 0)
    return np.repeat(np.arange(len(a_start)), size), ranges(first, size)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending (sorting is many times faster than ``np.unique``'s hashing)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Aligned:
    """Distinct units, aligned: numbers of tokens, groups and links, links by unit, groups as text."""

    def __init__(self, tokens: Tokens, names: list[str]):
        n = len(names)
        self.valid = np.ones(n, bool)
        self.n_a, self.n_b, self.n_groups = (np.zeros(n, np.int64) for _ in range(3))
        self.text = [""] * n
        owner, links = [], []
        for some, text in _calls(names):
            both = tokens.encoded(text)
            for ks, pair in [(some, both)] if both else [(some[i:i + 1], tokens.encoded(names[k])) for i, k in enumerate(some)]:
                if pair is None:
                    self.valid[ks] = False
                else:
                    self._take(tokens, names, ks, *pair, owner, links)
        owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        links = np.concatenate(links) if links else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        #: Links (``a << 32 | b``) of all units, one unit after another.
        self.links = links[order]
        self.n_links = np.bincount(owner, minlength=n).astype(np.int64)

    def _take(self, tokens, names, ks, a, b, owner, links) -> None:
        a_end, b_end = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
        a_start, b_start = a_end - tokens.a_size[a], b_end - tokens.b_size[b]
        # Byte where each unit starts: a space, then its text.
        head = starts_of(np.array([len(names[k].encode()) + 1 for k in ks], np.int64))[:-1]
        side = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
        start = np.r_[a_start, b_start]
        order, group = coalesced(start, np.r_[a_end, b_end], side)
        unit = np.searchsorted(head, start, "right") - 1
        n = len(ks)
        self.n_a[ks] = np.bincount(unit[:len(a)], minlength=n)
        self.n_b[ks] = np.bincount(unit[len(a):], minlength=n)
        sized = order[np.r_[True, group[1:] != group[:-1]]]
        self.n_groups[ks] = np.bincount(unit[sized], minlength=n)
        # Groups as text: ids in order, A before B.
        order = order[np.lexsort((side[order], group))]
        last = np.r_[group[1:] != group[:-1], True]
        turn = np.r_[side[order][1:] != side[order][:-1], False]
        code = np.r_[a, b][order] + tokens.rows * np.where(last, 2, np.where(turn, 1, 0))
        whole = "".join(map(tokens.written.__getitem__, code.tolist()))
        sizes = np.bincount(unit[order], weights=tokens.written_size[code], minlength=n).astype(np.int64)
        at = starts_of(sizes).tolist()
        for k, x, y in zip(ks.tolist(), at, at[1:]):
            self.text[k] = whole[x:y - 1]
        left, right = overlaps(a_start, a_end, b_start, b_end)
        owner.append(ks[unit[:len(a)][left]])
        links.append(a[left] << 32 | b[right])


# --- chunks ------------------------------------------------------------------------------------

class Chunk:
    """The documents of a chunk over its distinct units."""

    def __init__(self, tokens: Tokens, texts: list[str | None]):
        place: defaultdict[str, int] = defaultdict(count().__next__)
        codes = [np.fromiter(map(place.__getitem__, units(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        self.units = Aligned(tokens, list(place))
        valid = self.units.valid
        self.codes = [c if len(c) and valid[c].all() else c[:0] for c in codes]
        self.starts = starts_of(np.array([len(c) for c in self.codes], np.int64))
        self.flat = np.concatenate([np.empty(0, np.int32), *self.codes])

    def sums(self, of_units: np.ndarray) -> np.ndarray:
        """Sums over the units of each document."""
        return run_sums(of_units[self.flat], self.starts)

    def groups(self) -> Iterator[str]:
        """The groups of each document as text; empty without tokens."""
        for c in self.codes:
            yield ";".join(map(self.units.text.__getitem__, c.tolist()))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs, the documents of the chunk that hold each, and the place in that
        list of every link of every unit."""
        keys = distinct(self.units.links)
        at = np.searchsorted(keys, self.units.links)
        first, size = starts_of(self.units.n_links)[:-1], self.units.n_links
        seen = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.flat), _SLICE), "right") - 1
        edges = np.unique(np.r_[cuts, len(self.codes)])
        for x, y in zip(edges, edges[1:]):
            flat = self.flat[self.starts[x]:self.starts[y]].astype(np.int64)
            if len(flat) == 0:
                continue
            doc = np.repeat(np.arange(y - x), np.diff(self.starts[x:y + 1]))
            held = distinct(doc * len(size) + flat)
            doc, unit = held // len(size), held % len(size)
            both = np.repeat(doc, size[unit]) * len(keys) + at[ranges(first[unit], size[unit])]
            seen += np.bincount(distinct(both) % len(keys), minlength=len(keys))
        return keys, seen, at


def _models(spark, folder: str, a_file: str, b_file: str):
    """The tokenizer files as a broadcast of their own, fixed size."""
    with open(f"{folder}/{a_file}", encoding="utf-8") as file:
        a = json.dumps(json.load(file))
    with open(f"{folder}/{b_file}", "rb") as file:
        return spark.sparkContext.broadcast((a, file.read()))


def _digests(models):
    """Rows of documents (units as codes) and, per chunk, one row with its pairs and units."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*models.value)
        for number, rows, schema in cut(batches):
            ids, chunk = rows["doc_id"], Chunk(tokens, rows["_text"])
            u, n = chunk.units, len(ids)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in chunk.groups()]
            keys, seen, at = chunk.pairs()
            none = [None] * n
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * (n + 1), pa.int64()), pa.array([*ids, None], schema.field("doc_id").type),
                *(pa.array([*chunk.sums(x).tolist(), None], pa.int64()) for x in (u.n_a, u.n_b, u.n_groups, u.n_links)),
                pa.array([*digests, None], pa.string()), pa.array([*map(packed, chunk.codes), None], pa.binary()),
                pa.array([*none, keys], pa.list_(pa.int64())), pa.array([*none, seen], pa.list_(pa.int64())),
                pa.array([*none, packed(u.n_links)], pa.binary()), pa.array([*none, packed(at)], pa.binary()),
            ], names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "keys", "seen", "unit_links", "link_at"])
    return run


def _scored(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document, from the counts of its chunk's pairs."""
    whole = rows["link_at"].notna()
    head, docs = rows[whole].iloc[0], rows[~whole]
    n = np.zeros(len(answers), np.int64)
    best = np.zeros(len(answers), np.int64)
    n[answers["at"]] = answers["n"]
    best[answers["at"]] = answers["best"]
    at, starts = unpacked(head["link_at"]), starts_of(unpacked(head["unit_links"]))
    unit_n, unit_best = run_sums(n[at], starts), run_sums(best[at], starts)
    codes = [unpacked(c) for c in docs["codes"]]
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    out["n_best"] = [int(unit_best[c].sum()) for c in codes]
    out["count_sum"] = [int(unit_n[c].sum()) for c in codes]
    return out


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))


def _chunks(docs: DataFrame, folder: str, a_file: str, b_file: str, id_col: str, text_col: str) -> DataFrame:
    plain = _plain(docs, id_col, text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    return stored(plain.mapInArrow(_digests(_models(docs.sparkSession, folder, a_file, b_file)),
                  f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary,"
                  " keys array<long>, seen array<long>, unit_links binary, link_at binary"), "aligned")


def _counted(chunks: DataFrame) -> DataFrame:
    """``(key, n, best)`` of all pairs of a table of chunks."""
    pairs = entries(chunks).groupBy("key").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("key", 32))
    # An A id has at most as many pairs as B has ids.
    return pairs.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).cast("int")).drop("a")


def links(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, documents, best)``: each linked id pair, how many documents link it, and whether that is
    the most of its A id. Rows that share an id count one by one; null and empty texts link nothing."""
    return _counted(_chunks(docs, folder, a_file, b_file, id_col, text_col)).select(
        F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(_WIDTH - 1).cast("int").alias("b"),
        F.col("n").alias("documents"), (F.col("best") == 1).alias("best"))


def groups(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, groups)``: ``array<struct<a: array<int>, b: array<int>>>`` of every row, in text order;
    empty for null and empty texts and for texts that a tokenizer doesn't give back byte for byte."""
    plain = _plain(docs, id_col, text_col)
    models = _models(docs.sparkSession, folder, a_file, b_file)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*models.value)
        for _, rows, schema in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], schema.field("doc_id").type), pa.array(list(Chunk(tokens, rows["_text"]).groups()), pa.string())],
                                             names=["doc_id", "groups"])

    def numbers(part):
        return F.transform(F.split(part, ","), lambda x: x.cast("int"))

    written = plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, groups string")
    whole = F.filter(F.split("groups", ";"), lambda g: g != "")
    return written.select("doc_id", F.transform(whole, lambda g: F.struct(
        numbers(F.substring_index(g, "|", 1)).alias("a"), numbers(F.substring_index(g, "|", -1)).alias("b"))).alias("groups"))


def summaries(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum)``, a row per row of ``docs``.

    ``groups_sha256`` hashes ``a1,a2|b1;a3|b2,b3``. ``n_best`` counts links whose pair is the most
    frequent of its A id over all documents, ties included; ``count_sum`` adds the pairs' document
    counts. Null and empty texts, and texts whose tokens do not give their bytes back, have zeros and
    an empty hash. Rows that share an id stay apart and count one by one; other columns are ignored.
    """
    chunks = _chunks(docs, folder, a_file, b_file, id_col, text_col)
    answers = entries(chunks).drop("n").join(_counted(chunks), "key").select(F.col("chunk").alias("part"), "at", "n", "best")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.drop("keys", "seen").groupBy("chunk").cogroup(answers.groupBy("part")).applyInPandas(
        _scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
