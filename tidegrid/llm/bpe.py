"""Byte-level BPE: texts to token ids and back.

Encoding speculates and verifies.  Greedy longest match proposes the tokens of a word; one vectorised look-up tests
every adjacent pair of the proposals for compatibility (the exact encoding of two tokens' bytes is these two tokens);
a word whose pairs are all compatible is exact, and only the others are merged rank by rank.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import id_type, per_document

DEFAULT_FILE = "byte_bpe_50k.json"


def vocabulary_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary files: printable Latin-1 itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    SHORT = 200

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {self.ids[to_bytes(a)] << 32 | self.ids[to_bytes(b)]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[to_bytes(a + b)] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.reach: dict[bytes, int] = {}  # length of the longest token that starts with these two bytes
        for b in self.ids:
            self.reach[b[:2]] = max(len(b), self.reach.get(b[:2], 1))
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self._tables()

    def _tables(self) -> None:
        """Merges and tokens as sorted keys, for many words at once."""
        self.first = np.array(self.single, np.int64)
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_rank = np.array([self.ranks[k] for k in self.pairs.tolist()], np.int64)
        self.into = np.array([*self.merged, -1], np.int64)
        self.byte_rank = self.rank_of(np.repeat(self.first, 256), np.tile(self.first, 256))
        edges, ends = {}, {b: i for i, b in enumerate(self.single)}  # a node is a prefix of a token; the first 256 are the bytes
        for token, i in self.ids.items():
            node = token[0]
            for b in token[1:]:
                node = edges.setdefault(node << 8 | b, 256 + len(edges))
            ends[node] = i
        self.edges = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.token_at = np.full(256 + len(edges), -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; the number of merges where there is none."""
        if not len(self.pairs):
            return np.zeros(len(left), np.int64)
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, self.pair_rank[at], len(self.merged))

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words, none empty, a byte of each at a time: their tokens in turn, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner, last = np.arange(len(words)), ends.copy()
        node = data[ends - np.diff(ends, prepend=0)]
        at = ends - np.diff(ends, prepend=0) + 1  # next byte
        token, after = self.first[node], at.copy()  # longest token so far, and the byte after it
        owners, tokens = [], []
        while len(owner):
            open_ = at < last
            if len(self.edges):
                keys = node << 8 | data[np.minimum(at, len(data) - 1)]
                edge = np.searchsorted(self.edges, keys)
                edge[edge == len(self.edges)] = 0
                open_ &= self.edges[edge] == keys
            else:
                open_[:] = False
            go = np.flatnonzero(open_)
            if len(go):
                node[go] = self.edge_to[edge[go]]
                at[go] += 1
                ends_here = self.token_at[node[go]]
                hit = ends_here >= 0
                token[go[hit]], after[go[hit]] = ends_here[hit], at[go[hit]]
            stop = np.flatnonzero(~open_)
            if len(stop):
                owners.append(owner[stop])
                tokens.append(token[stop])
                more = stop[after[stop] < last[stop]]
                node[more] = data[after[more]]
                token[more] = self.first[node[more]]
                at[more] = after[more] = after[more] + 1
                if len(more) < len(stop):
                    stays = np.ones(len(owner), bool)
                    stays[stop] = False
                    stays[more] = True
                    owner, last, node, at, token, after = (x[stays] for x in (owner, last, node, at, token, after))
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact encoding of many short words, none empty, a merge of each at a time: their tokens in turn, and how many each has."""
        none, data = len(self.merged), np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        place = np.arange(len(data))  # of a token's first byte in the data
        parts, owner = self.first[data], np.repeat(np.arange(len(words)), counts)
        ranks = np.full(len(data), none)
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self.byte_rank[data[:-1] << 8 | data[1:]], none)
        left = np.full(len(data), -1)
        while len(parts):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(starts, append=len(parts))
            ended = np.repeat(best == none, sizes)
            left[place[ended]] = parts[ended]
            keep = ~ended
            parts, owner, place, ranks = parts[keep], owner[keep], place[keep], ranks[keep]
            best = np.repeat(best, sizes)[keep]
            at = np.flatnonzero(ranks == best)
            at = at[np.diff(owner[at], prepend=-1) != 0]  # leftmost of each word
            parts[at] = self.into[ranks[at]]
            gone = np.ones(len(parts), bool)
            gone[at + 1] = False
            at -= np.arange(len(at))  # every word before has lost one
            parts, owner, place, ranks = parts[gone], owner[gone], place[gone], ranks[gone]
            for i in (at[(at > 0) & (owner[at - 1] == owner[at])] - 1, at):
                j = np.minimum(i + 1, len(parts) - 1)
                same = (owner[j] == owner[i]) & (j > i)
                ranks[i] = np.where(same, self.rank_of(parts[i], parts[j]), none)
        kept = left >= 0
        return left[kept], np.bincount(np.repeat(np.arange(len(words)), counts)[kept], minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: always join the pair of lowest rank, leftmost first."""
        parts = [self.single[b] for b in word]
        if len(parts) > self.SHORT:
            return self._merge_long(parts)
        rank, none, merged = self.ranks.get, len(self.merged), self.merged
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words without any break."""
        n, rank, merged = len(parts), self.ranks.get, self.merged
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


def _lists(flat: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    flat, ends = flat.tolist(), np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _rows(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    data, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _within(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each key is in a sorted table."""
    at = np.searchsorted(table, keys)
    inside = at < len(table)
    inside[inside] = table[at[inside]] == keys[inside]
    return inside


class Encoder:
    """Encodes words; keeps what it has learnt about pairs and words up to a fixed number of entries."""

    MOST_PAIRS = 2_000_000
    MOST_WORDS = 600_000
    FEW = 64  # fewer words are encoded one by one
    STOPS = frozenset(".,;:!?\n")  # one of these after a word is a piece of its own

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.v = Vocabulary(path)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.young, self.old = self._store(), self._store()
        self.good = np.zeros(0, np.int64)  # sorted keys of compatible pairs
        self.bad = np.zeros(0, np.int64)
        self.whole = np.zeros(len(self.v.bytes), np.int8)  # 1: bytes of this token are this token, 2: they are not, 0: not tried
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def propose(self, word: bytes) -> list[int]:
        ids, reach, out, i, n = self.v.ids, self.v.reach, [], 0, len(word)
        while i < n:
            j = i + reach.get(word[i : i + 2], 1)
            if j > n:
                j = n
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def _whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether the bytes of each token are encoded as this token."""
        new = np.unique(tokens[self.whole[tokens] == 0])
        if len(new):
            self.whole[new] = [2 - (ids == [t]) for t, ids in zip(new.tolist(), self.merged([self.v.bytes[t] for t in new.tolist()]))]
        return self.whole[tokens] == 1

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair ``left << 32 | right`` stays as it is; pairs never seen before are tried once."""
        distinct, back = np.unique(keys, return_inverse=True)
        new = distinct[~(_within(distinct, self.good) | _within(distinct, self.bad))]
        if len(new):
            b, both = self.v.bytes, [[k >> 32, k & 0xFFFFFFFF] for k in new.tolist()]
            ok = np.fromiter((x == ids for x, ids in zip(both, self.merged([b[x] + b[y] for x, y in both]))), bool, len(new))
            self.good, self.bad = np.sort(np.append(self.good, new[ok])), np.sort(np.append(self.bad, new[~ok]))
        result = _within(distinct, self.good)[back]
        if len(self.good) + len(self.bad) > self.MOST_PAIRS:
            self.good, self.bad = self.good[:0], self.bad[:0]
        return result

    def merged(self, todo: list[bytes]) -> list[list[int]]:
        """Exact encodings; short words many at once."""
        short = [w for w in todo if 0 < len(w) <= self.v.SHORT]
        if len(short) < self.FEW:
            return [self.v.merge(w) for w in todo]
        ids = iter(_lists(*self.v.merge_all(short)))
        return [next(ids) if 0 < len(w) <= self.v.SHORT else self.v.merge(w) for w in todo]

    def proposed(self, todo: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words in turn, and the number of tokens of each; many at once where all are short."""
        if len(todo) >= self.FEW and 0 < min(map(len, todo)) and max(map(len, todo)) <= self.v.SHORT:
            return self.v.propose_all(todo)
        ids = [self.propose(w) for w in todo]
        return np.fromiter((t for p in ids for t in p), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def words(self, todo: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit numbers."""
        long_ = [w for w in todo if len(w) > self.v.SHORT]
        if long_ and len(long_) < len(todo):
            ids = {w: i for w, i in zip(long_, self.words(long_))}
            rest = iter(self.words([w for w in todo if len(w) <= self.v.SHORT]))
            return [ids[w] if len(w) > self.v.SHORT else next(rest) for w in todo]
        flat, counts = self.proposed(todo)
        owner = np.repeat(np.arange(len(todo)), counts)
        wrong = np.zeros(len(todo), bool)
        wrong[owner[~self._whole(flat)]] = True
        inner = owner[1:] == owner[:-1]
        keys = (flat[:-1] << 32 | flat[1:])[inner]
        wrong[owner[1:][inner][~self.compatible(keys)]] = True
        out = _rows(flat, counts)
        wrong = np.flatnonzero(wrong).tolist()
        for i, ids in zip(wrong, self.merged([todo[i] for i in wrong])):
            out[i] = array("i", ids).tobytes()
        return out

    def _pretokens(self, chunk: str) -> list[str]:
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isalpha():
            return [chunk]
        if bare[-1:] in self.STOPS and bare[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return [chunk[a:b] for _, (a, b) in self.split(chunk)]

    @staticmethod
    def _store(words=(), ids=()) -> tuple[pa.Array, pa.Array]:
        """Words and their ids as 32-bit numbers."""
        return pa.array(words, pa.large_string()), pa.array(ids, pa.large_binary())

    def _find(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the younger store and the older one behind it; -1 where it is in neither."""
        at = pc.index_in(words, value_set=pa.concat_arrays([self.young[0], self.old[0]]))
        return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _known(self, need: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of words, and the place there of each of the distinct words ``need``.

        Words that come again stay in the store, others are forgotten.
        """
        if len(self.young[0]) > self.MOST_WORDS // 2:
            self.young, self.old = self._store(), self.young
        at = self._find(need)
        new = need.filter(pa.array(at < 0)).to_pylist()
        pieces = {c: self._pretokens(c) for c in new}
        parts = list({p for ps in pieces.values() if len(ps) > 1 for p in ps}.difference(new))
        named, stored = self._store(parts)[0], pa.concat_arrays([self.young[1], self.old[1]])
        part_at = self._find(named) if parts else np.zeros(0, np.int64)
        ids = dict(zip(parts, stored.take(pa.array(part_at, mask=part_at < 0)).to_pylist()))
        todo = [*(c for c, ps in pieces.items() if len(ps) < 2), *(p for p, i in ids.items() if i is None)]
        ids.update(zip(todo, self.words([p.encode() for p in todo]) if todo else ()))
        ids.update([(c, b"".join([ids[p] for p in ps])) for c, ps in pieces.items() if len(ps) > 1])
        more = [*new, *(p for p, i in zip(parts, part_at.tolist()) if i < 0)]
        added = self._store(more, [ids[c] for c in more])
        again = np.union1d(at, part_at)
        again = pa.array(again[again >= len(self.young[0])] - len(self.young[0]))  # from the older store to the younger
        at[at < 0] = len(stored) + np.arange(len(new))
        self.young = tuple(pa.concat_arrays([y, o.take(again), n]) for y, o, n in zip(self.young, self.old, added))
        return pa.concat_arrays([stored, added[1]]), at

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces that are encoded independently: cut before each space that a non-space follows."""
        first, *rest = re.split(r" (?=\S)", text)
        return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        rows = pa.array(texts, pa.large_string())
        words = pc.split_pattern(rows, " ")
        ends, flat = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        names, at = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        opens = ends[:-1]
        # a word after a space is a chunk, unless white space or the end of the text follows that space
        odd = self._spaced(names)[at]
        odd[opens] = False
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        slow = np.bincount(owner[odd], minlength=len(texts)) > 0
        for s in self.v.special:
            slow |= pc.match_substring(rows, s).to_numpy(zero_copy_only=False)
        later = ~slow[owner]
        later[opens] = False
        used = np.flatnonzero(np.bincount(at[later], minlength=len(names)))
        first = np.unique(at[opens[~slow & (pc.binary_length(rows).to_numpy() > 0)]])
        first = first[pc.binary_length(names).to_numpy()[first] > 0]
        chunks = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), names.take(pa.array(used)), pa.scalar(" ", pa.large_string()))
        known, places = self._known(pa.concat_arrays([chunks, names.take(pa.array(first))]))
        place = np.full(len(names), -1)
        place[used] = places[: len(used)]
        picks = place[at]
        place[:] = -1  # what is not encoded here: an empty first word, and all words of slow texts
        place[first] = places[len(used) :]
        picks[opens] = place[at[opens]]
        picks[slow[owner]] = -1
        ids = known.take(pa.array(picks, mask=picks < 0))
        _, cuts, data = ids.buffers()
        cuts = np.frombuffer(cuts, np.int64)[ends].tolist()
        data = b"" if data is None else data.to_pybytes()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        left = np.flatnonzero(slow).tolist()
        if left:
            for i, row in zip(left, self._one_by_one([texts[i] for i in left])):
                out[i] = row
        return out

    @staticmethod
    def _spaced(names: pa.Array) -> np.ndarray:
        """Whether each word is empty or begins with white space."""
        starts = pc.utf8_slice_codeunits(names, 0, 1).dictionary_encode()
        return np.array([not c or c.isspace() for c in starts.dictionary.to_pylist()], bool)[starts.indices.to_numpy()]

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        """The same for texts with special tokens or white space after a space."""
        parts = []  # per text: pieces, or the bytes of a special token's id
        for t in texts:
            if self.special and any(s in t for s in self.v.special):
                own = []
                for i, s in enumerate(self.special.split(t)):
                    own += [array("i", [self.v.special[s]]).tobytes()] if i % 2 else self._cut(s) if s else []
            else:
                own = self._cut(t) if t else []
            parts.append(own)
        need = self._store(list({c for own in parts for c in own if c.__class__ is str}))[0]
        ids, places = self._known(need)
        known = dict(zip(need.to_pylist(), ids.take(pa.array(places)).to_pylist()))
        return [b"".join([known[c] if c.__class__ is str else c for c in own]) for own in parts]


SLICE = 1 << 22


def _parts(texts: list[str]):
    """The texts in parts of about SLICE characters: words are told apart once for each part."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    yield texts[at:]


def _id_lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _texts_of(pieces: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Texts of lists of ids, whose bytes are ``pieces``."""
    out = []
    for at in range(0, len(lists), 256):
        part = lists.slice(at, 256)
        ends = np.cumsum([0, *part.value_lengths().fill_null(0).to_pylist()])
        _, cuts, data = pieces.take(part.flatten()).buffers()
        cuts = np.frombuffer(cuts, np.int64)[ends].tolist() if ends[-1] else [0] * len(ends)
        data = b"" if data is None else data.to_pybytes()
        out += [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
    return pa.array(out, pa.string())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: ``id_col, ids array<int>``, and with ``decoded`` what ``decode`` makes of the ids.

    The result equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``; the texts of special
    tokens become their ids.  NULL and empty texts give an empty array, repeated rows give a row each, other columns
    are left out.  No shuffle; memory is bounded by a slice of the texts and two stores of fixed size.
    """
    path = path or vocabulary_path()

    def make():
        encoder = Encoder(path)
        pieces = pa.array(encoder.v.bytes, pa.large_binary()) if decoded else None

        def work(texts):
            ids = _id_lists([row for part in _parts(texts) for row in encoder.texts(part)])
            return {"ids": (ids, None)} | ({"decoded": (_texts_of(pieces, ids), None)} if decoded else {})

        return work

    return per_document(df, make, f"`{id_col}` {id_type(df, id_col)}, ids array<int>{', decoded string' * decoded}", [text_col, id_col], slice_rows=2048)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Texts of token ids: ``id_col, ids_col, decoded``.  Bytes that are not UTF-8 become U+FFFD; NULL gives ``""``."""
    path = path or vocabulary_path()

    def run(batches):
        pieces = None
        for whole in batches:
            if pieces is None:
                pieces = pa.array(Vocabulary(path).bytes, pa.large_binary())
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lists = batch.column(ids_col)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), lists, _texts_of(pieces, lists)], names=[id_col, ids_col, "decoded"])

    picked = df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`"))
    return picked.mapInArrow(run, f"`{id_col}` {id_type(df, id_col)}, `{ids_col}` array<int>, decoded string")
