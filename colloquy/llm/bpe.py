"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one encoding, so its last token is unique.  The
encoder stores that token for each prefix: a token t may end a prefix if the prefix before it ends
in a token u such that the pair u, t survives merging (merging the bytes of both gives u, t
again).  Appending bytes only adds prefixes; an edit keeps all prefixes before it and is done
once the stored tokens behind it agree again.

:class:`PrefixEncoder` does this for one piece; there, merging two tokens decides whether a pair is
valid.  :class:`BatchEncoder` does it for the new pieces of many texts at once on arrays, and undoes
merges instead.

Texts are split by the tokenizer's pattern and each match is encoded by itself, without special
tokens.  Decoding joins the tokens' bytes.  Defined edge cases: a null text is the empty text and
has no tokens; repeated rows are encoded each for itself; texts of any length are encoded whole, an
empty table gives no rows, and columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import texts_in_small_batches

#: Pieces, and pairs of the scalar encoder, that a worker remembers at most; when full, it starts anew.
REMEMBERED = 400_000
#: Pieces of more bytes go through the scalar encoder and are not remembered.
LONGEST_REMEMBERED = 64
#: Text that is split before its new pieces are encoded together.
CHUNK_CHARS = 1 << 20
#: Slots of the table of pairs whose validity is known (any number gives the same results).
PAIR_SLOTS_BITS = 18


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file: base64 of the token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Memory(dict):
    """A dict of bounded size: when it is full, it starts anew."""

    def __setitem__(self, key, value) -> None:  # noqa: ANN001
        if len(self) >= REMEMBERED:
            self.clear()
        super().__setitem__(key, value)


class PrefixEncoder:
    """Encoder of single pieces, with exact appends and edits.

    The tokens that end at each byte come from an Aho-Corasick automaton of the vocabulary.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.width = max(self.bytes_of, default=0) + 1
        self._ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._ends.add_word(token.decode("latin-1"), rank)
        self._ends.make_automaton()
        self._pairs: dict[int, bool] = Memory()
        self._whole: dict[int, bool] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Plain merging by lowest rank down to ``stop`` parts; used on one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = min(((r, i) for r, i in ranked if r is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _reachable(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
        return known

    def _pair(self, left: int, right: int) -> bool:
        a, b = self.bytes_of[left], self.bytes_of[right]
        return self.merged(a + b) == [a, b]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last[i]`` is the last token of ``data[:i + 1]``; add what is missing."""
        size_of, pairs, width = self.size_of, self._pairs, self.width
        done = len(last)
        for end, token in self._ends.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            if end < done:
                continue  # this prefix has its token
            start = end + 1 - size_of[token]
            if start:
                key = last[start - 1] * width + token
                good = pairs.get(key)
                if good is None:
                    good = pairs[key] = self._pair(last[start - 1], token)
            else:
                good = self._reachable(token)
            if good:
                last.append(token)
                done += 1
        if done < len(data):
            raise ValueError(f"no token ends at byte {done + 1}")
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The encoding of ``data + more`` from that of ``data``, whose prefixes stay as they are."""
        return data + more, self.extend(data + more, list(last))

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``data[start:stop]``: prefixes before ``start`` stay; behind the edit, work ends
        once the last tokens of as many prefixes in a row agree as two of the longest token have bytes."""
        edited, shift = data[:start] + new + data[stop:], start + len(new) - stop
        out, agree = list(last[:start]), 0
        while len(out) < len(edited):
            self.extend(edited[: len(out) + 1], out)
            at = len(out) - 1
            agree = agree + 1 if at >= start + len(new) and last[at - shift] == out[-1] else 0
            if agree > 2 * self.longest:
                out += last[at - shift + 1 :]
        return edited, out

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The ids, walking back from the last prefix."""
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= self.size_of[last[end - 1]]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tokens(data, self.extend(data, []))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A slot of a table of 2**bits for each key."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """A map of int64 keys, none negative, to int64 values on arrays: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        slot = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several keys for a slot one stays
            kept = self.keys[slot] == keys
            self.values[slot[kept]] = values[kept]
            keys, values, slot = keys[~kept], values[~kept], (slot[~kept] + 1) & ((1 << self.bits) - 1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = _slots(wanted, self.bits)
        there = self.keys[slot]
        out = np.where(there == wanted, self.values[slot], -1)
        left = np.flatnonzero((there != wanted) & (there >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            out[left] = np.where(there == wanted[left], self.values[slot], -1)
            more = (there != wanted[left]) & (there >= 0)
            left, slot = left[more], slot[more]
        return out


class Tables:
    """A vocabulary as arrays, made once and sent to the workers; its size is that of one vocabulary file.

    ``left`` and ``right`` are the two tokens whose merge makes a token (-1 for single bytes), ``made``
    finds the token that merging a pair makes.  The tokens are a trie: ``steps`` finds the next state by
    state * 256 + byte, ``token`` is the token that ends in a state, if any.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        scalar = PrefixEncoder(ranks)
        self.width = scalar.width
        self.size = np.zeros(self.width, dtype=np.int32)
        self.left = np.full(self.width, -1, dtype=np.int64)
        self.right = np.full(self.width, -1, dtype=np.int64)
        trie: dict[int, int] = {}
        ends = {}
        for token, rank in ranks.items():
            parts = scalar.merged(token, 2)
            if len(parts) > 2 or (len(parts) == 2 and b"".join(parts) not in ranks):
                continue  # merging never makes this token
            self.size[rank] = len(token)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
            state = 0
            for byte in token:
                state = trie.setdefault(state * 256 + byte, len(trie) + 1)
            ends[state] = rank
        self.steps = Lookup(np.fromiter(trie, dtype=np.int64, count=len(trie)), np.fromiter(trie.values(), dtype=np.int64, count=len(trie)))
        self.token = np.full(len(trie) + 1, -1, dtype=np.int64)
        self.token[list(ends)] = list(ends.values())
        split = np.flatnonzero(self.left >= 0)
        self.made = Lookup(self.left[split] * self.width + self.right[split], split)


class BatchEncoder:
    """The prefix dynamic program for many pieces at once: step i gives all pieces their last token at byte i.

    A pair of tokens survives merging if no merge across their border comes before the merges that
    make them.  Undoing those merges from the last one shows the tokens that ever meet at the border.
    """

    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self._key = np.full(1 << PAIR_SLOTS_BITS, -1, dtype=np.int64)
        self._good = np.zeros(1 << PAIR_SLOTS_BITS, dtype=bool)

    def _survive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.t
        good = np.ones(len(a), dtype=bool)
        limit, live = np.full(len(a), np.iinfo(np.int64).max), np.arange(len(a))  # a merge across counts below this rank
        while len(live):
            made = t.made.find(a * t.width + b)
            bad = (made >= 0) & (made < limit)
            good[live[bad]] = False
            whole_a, whole_b = t.left[a] < 0, t.left[b] < 0
            go = ~bad & ~(whole_a & whole_b)
            live, a, b, whole_a, whole_b = live[go], a[go], b[go], whole_a[go], whole_b[go]
            undo_a = ~whole_a & (whole_b | (a > b))
            limit = np.where(undo_a, a, b + 1)  # of equal merges the left one comes first
            a, b = np.where(undo_a, t.right[a], a), np.where(undo_a, b, t.left[b])
        return good

    def _pairs_survive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.t.width + b
        slot = _slots(key, PAIR_SLOTS_BITS)
        good, new = self._good[slot], np.flatnonzero(self._key[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[first]
            found = self._survive(a[one], b[one])
            good[new] = found[back]
            # of several keys for a slot numpy keeps one, and the same one for both tables
            self._key[slot[one]] = key[one]
            self._good[slot[one]] = found
            lost = self._key[slot[one]] != key[one]
            if lost.any():
                self._key[slot[one[lost]]] = -1
        return good

    def _matches(self, data: np.ndarray, room: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For sizes 1, 2, ... the (first byte, token) of every token of that size that stands inside a piece."""
        t, found = self.t, []
        at, state = np.arange(len(data)), np.zeros(len(data), dtype=np.int64)
        while len(at):
            state = t.steps.find(state * 256 + data[at + len(found)])
            known = state >= 0
            at, state = at[known], state[known]
            token = t.token[state]
            full = token >= 0
            found.append((at[full], token[full]))
            more = room[at] > len(found)
            at, state = at[more], state[more]
        return found

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and the number of ids of each; no piece is empty."""
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        if not len(lens):
            return lens, lens
        stops = np.cumsum(lens)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        place = np.arange(len(data)) - np.repeat(stops - lens, lens)
        found = self._matches(data, np.repeat(lens, lens) - place)
        first, token = (np.concatenate(x) for x in zip(*found[::-1], strict=True))  # the longest first
        tried, turn, ends = np.zeros(len(data), dtype=np.int64), [], []
        for size in range(len(found), 0, -1):
            end = found[size - 1][0] + size - 1  # each byte once
            ends.append(end)
            turn.append(tried[end])
            tried[end] += 1
        end, turn = np.concatenate(ends), np.concatenate(turn)
        # step by step, at each byte the longest token first
        turns = int(tried.max()) + 1
        step = place[end] * turns + turn
        order = np.argsort(step.astype(np.uint16) if int(lens.max()) * turns < 1 << 16 else step, kind="stable")
        first, end, token = first[order], end[order], token[order]
        bounds = np.flatnonzero(np.diff(step[order], prepend=-1, append=-1)).tolist()
        last = np.full(len(data), -1, dtype=np.int64)
        for a, b in zip(bounds, bounds[1:], strict=False):
            e = end[a:b]
            open_ = last[e] < 0
            e, f, t = e[open_], first[a:b][open_], token[a:b][open_]
            inner = place[f] > 0
            good = ~inner
            before = last[f[inner] - 1]
            good[inner] = (before >= 0) & self._pairs_survive(np.maximum(before, 0), t[inner])
            last[e[good]] = t[good]
        if (last < 0).any():
            raise ValueError(f"no token ends at byte {int(place[np.argmax(last < 0)]) + 1} of a piece")
        at, own, back = stops - 1, np.arange(len(pieces)), []
        begin, counts = stops - lens, np.zeros(len(pieces), dtype=np.int64)
        while len(at):
            now = last[at]
            back.append((own, now))
            counts[own] += 1
            at = at - self.t.size[now]
            more = at >= begin[own]
            at, own = at[more], own[more]
        behind, flat = np.cumsum(counts), np.empty(int(counts.sum()), dtype=np.int64)
        for k, (own, now) in enumerate(back, 1):
            flat[behind[own] - k] = now
        return flat, counts


def _strings(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def _joined(strings: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
    """The joined strings of ``ids[a:b]`` for neighbours a, b in ``bounds``."""
    taken = strings.take(pa.array(ids))
    data = memoryview(taken.buffers()[2] or b"")
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
    return (data[a:b] for a, b in zip(at, at[1:], strict=False))


#: One part of a pattern that Python's re reads as the regex package does, once its classes are spelled out.
SIMPLE = r"\\p\{[LN]\}|\\[sS]|\[\^?(?:\\p\{[LN]\}|\\s)+\]|\(\?[!:]|[A-Za-z0-9' |?+*)]"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, as the regex package finds them.

    A pattern of simple parts is given to Python's re, which is faster, with the classes spelled out as
    the regex package has them; as re is slow at classes beyond the first 65,536 code points, texts that
    hold any such go to the regex package.
    """
    import regex

    full = regex.compile(pattern).findall
    if not re.fullmatch(f"(?:{SIMPLE})*", pattern):
        return full
    low = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    spelled = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        spans = regex.finditer(f"{kind}+", low[:0xD800]), regex.finditer(f"{kind}+", low[0xD800:])
        spelled[kind] = "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for span in spans for m in span)

    def part(m: re.Match) -> str:
        if m[0] == r"\S":
            return f"[^{spelled[chr(92) + 's']}]"
        if m[0] in spelled:
            return f"[{spelled[m[0]]}]"
        return re.sub(r"\\p\{[LN]\}|\\s", lambda k: spelled[k[0]], m[0])

    fast, high = re.compile(re.sub(SIMPLE, part, pattern)).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: full(text) if high(text) else fast(text)


class Numbers(dict):
    """Numbers pieces as they are first seen; ``new`` holds those of the present chunk."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = number = self.next
        self.next += 1
        self.new.append(piece)
        return number


class TextEncoder:
    """Encodes whole texts: splits by the pattern, encodes new pieces together and remembers short ones.

    ``_known`` numbers the pieces; the ids of piece n are the ``_count[n]`` from ``_ids[_start[n]]``.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: Tables | None = None) -> None:
        self.ranks = ranks
        self._batch = BatchEncoder(tables or Tables(ranks))
        self._split = splitter(pattern)
        self._bytes_of = {r: t for t, r in ranks.items()}
        self._ranks_up_to = range(max(self._bytes_of, default=-1) + 1)
        self._forget()

    def _forget(self) -> None:
        self._known = Numbers()
        self._start = self._count = np.zeros(0, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.int32)

    @cached_property
    def pieces(self) -> PrefixEncoder:
        return PrefixEncoder(self.ranks)

    @cached_property
    def _tokens(self) -> pa.Array:
        return _strings([self._bytes_of.get(rank) for rank in self._ranks_up_to])

    @cached_property
    def _decimals(self) -> pa.Array:
        return _strings([b" %d" % rank for rank in self._ranks_up_to])

    def encode_chunks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of a run of texts, and the bounds of each text's among them, run by run."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield self._encode_chunk(held)
                held, size = [], 0
        if held:
            yield self._encode_chunk(held)

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        for ids, bounds in self.encode_chunks(texts):
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield ids[a:b].tolist()

    def _encode_new(self) -> int:
        """Store the ids of the pieces that got a number; where those that are not remembered begin."""
        known, new, ranks = self._known, self._known.new, self.ranks
        start, count = np.zeros(len(new), dtype=np.int64), np.ones(len(new), dtype=np.int64)
        datas = [p.encode() for p in new]
        whole = np.fromiter((ranks.get(d, -1) for d in datas), dtype=np.int64, count=len(new))
        size = np.fromiter(map(len, datas), dtype=np.int64, count=len(new))
        single = np.flatnonzero(whole >= 0)
        short = np.flatnonzero((whole < 0) & (size <= LONGEST_REMEMBERED))
        long = np.flatnonzero((whole < 0) & (size > LONGEST_REMEMBERED))
        flat, count[short] = self._batch.encode([datas[i] for i in short])
        encoded = [self.pieces.encode(datas[i]) for i in long]
        count[long] = [len(x) for x in encoded]
        order = np.concatenate([single, short, long])
        start[order] = len(self._ids) + np.cumsum(count[order]) - count[order]
        kept = len(self._ids) + len(single) + len(flat)
        self._ids = np.concatenate([self._ids, whole[single], flat, *encoded], dtype=np.int32, casting="unsafe")
        self._start, self._count = np.concatenate([self._start, start]), np.concatenate([self._count, count])
        for i in long:
            del known[new[i]]
        known.new = []
        return kept

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        numbers = [np.array(list(map(self._known.__getitem__, self._split(text))), dtype=np.int64) for text in texts]
        try:
            kept = self._encode_new()
        except ValueError:
            self._forget()  # the new pieces have numbers but no ids
            raise
        ends = np.cumsum([len(n) for n in numbers])
        number = np.concatenate(numbers)
        count = self._count[number]
        behind = np.cumsum(count)
        total = int(behind[-1]) if len(behind) else 0
        ids = self._ids[np.arange(total) + np.repeat(self._start[number] - behind + count, count)]
        bounds = np.r_[0, np.r_[0, behind][ends]]
        self._ids = self._ids[:kept]
        if self._known.next > REMEMBERED:
            self._forget()
        return ids, bounds

    def encode(self, text: str) -> list[int]:
        return self._encode_chunk([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes_of.__getitem__, ids))

    def digests(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[str], list[str]]:
        """The SHA-256 of each text's decimal ids, joined by one space, and of its decoded bytes."""
        decimals, decoded = _joined(self._decimals, ids, bounds), _joined(self._tokens, ids, bounds)
        return [hashlib.sha256(x[1:]).hexdigest() for x in decimals], [hashlib.sha256(x).hexdigest() for x in decoded]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, ids: bool = True) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) and, with ``digests``, the count of the ids and the
    SHA-256 of the ids and of the decoded bytes, computed where the ids are."""
    texts_in_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, Tables(ranks)))  # one vocabulary file, of fixed size

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder(*shared.value)
        for b in source:
            for start in range(0, b.num_rows, 256):
                at = start
                for found, bounds in coder.encode_chunks([t or "" for t in b["__text"].slice(start, 256).to_pylist()]):
                    rows = len(bounds) - 1
                    made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found))] if ids else []
                    if digests:
                        made += [pa.array(np.diff(bounds)), *(pa.array(x, pa.string()) for x in coder.digests(found, bounds))]
                    yield pa.RecordBatch.from_arrays([*(b[c].slice(at, rows) for c in keep), *made], names)
                    at += rows

    rows = docs.select(*keep, docs[text].alias("__text"))
    made = [*(["ids array<int>"] if ids else []), *(["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else [])]
    names = [*keep, *(x.split()[0] for x in made)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep), *made])
    return rows.mapInArrow(batches, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in column ``out``."""
    from pyspark.sql.functions import pandas_udf

    shared = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    @pandas_udf("binary")
    def joined(column):  # noqa: ANN001, ANN202
        return column.map(lambda x: None if x is None else b"".join(shared.value[i] for i in x))

    return encoded.withColumn(out, joined(ids))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, *public_vocabulary(), digests=True, ids=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each remaining document's ids, their count, and the digests of ids and decoded bytes."""
    return encode(docs, *public_vocabulary(), digests=True)
