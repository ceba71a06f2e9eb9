"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per partition.

Texts are cut into pieces, pieces into matches of the tokenizer's pattern, and the distinct matches that are no token
themselves are encoded together: rows (word, position, token) join the table of mergeable pairs, each word's leftmost
pair of minimum rank is contracted, and that is repeated until no pair is left. Decoding joins rows (text, position, id)
with the vocabulary and aggregates the bytes of every text in order.

A round contracts one pair of a word, so a match is contracted in segments of bounded length, and costs its length.
Segments overlap; they are joined at a boundary of tokens that both have. In a vocabulary whose tokens all encode to
themselves (as trained ones do; tests check the public one) a sequence of tokens is the encoding of its bytes if and
only if every two neighbours are the encoding of theirs. So a joint is right if the tokens on both sides of it, encoded
together, stay as they are, and only such joints are made; where none is found the segment grows.

Vocabulary and pattern come as a path and a string. Each worker builds its tables from the file; what it remembers of
words seen is bounded (``REMEMBERED``), and forgetting costs time only. The databases are in memory and never spill to a
folder: batches are bounded by their bytes, and long texts are decoded in parts.

Defined results: null text is empty; an empty text has no ids and decodes to nothing; repeated texts get equal ids; an
id outside the vocabulary is an error; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

#: Pieces remembered with their ids, at most; beyond that all are forgotten.
REMEMBERED = 400_000
#: Rows and bytes of text of a batch, rows of a word table, tokens decoded at once.
ROWS, BYTES, WORD_ROWS, TOKENS = 384, 2_000_000, 4_000_000, 400_000
#: Bytes by which segments of a long match follow each other, and bytes by which each reaches into the next.
SEGMENT, OVERLAP = 64, 48
#: White space as Unicode has it; the pattern's \s is read so.
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: From pending(key, tok), key being the word's number and the position (its low 32 bits): in each round the words that have
#: a pair left, contracted once, with positions closed up. A word's encoding are its rows of its last round.
CONTRACT = """
WITH RECURSIVE step(key, round, tok) AS (
  SELECT key, 0, tok FROM pending
  UNION ALL
  (WITH best AS (
     SELECT a.key >> 32 AS w, min(m.rank << 32 | (a.key & 4294967295)) AS k
     FROM step a JOIN step b ON b.key = a.key + 1 JOIN merges m ON m.pair = (a.tok::BIGINT << 32 | b.tok) GROUP BY 1),
   spot AS (SELECT w, (w << 32) + (k & 4294967295) AS place, (k >> 32)::INTEGER AS made FROM best)
   SELECT CASE WHEN key > place THEN key - 1 ELSE key END, round + 1, CASE WHEN key = place THEN made ELSE tok END
   FROM step JOIN spot ON key >> 32 = w WHERE key <> place + 1))
SELECT w, array_to_string(list(tok ORDER BY key), ' ') AS ids
FROM (SELECT key >> 32 AS w, max(round) AS round FROM step GROUP BY 1) JOIN (SELECT key >> 32 AS w, * FROM step) USING (w, round) GROUP BY w
"""
#: From incoming(t, ids): rows (text, position, id) join the vocabulary and are aggregated in order.
EXPAND = """
WITH rows AS (SELECT t, unnest(ids) AS id, generate_subscripts(ids, 1)::INTEGER AS pos FROM incoming)
SELECT t, count(*) AS n, from_hex(string_agg(shown, '' ORDER BY pos)) AS shown FROM rows JOIN vocabulary USING (id) GROUP BY t
"""


#: Texts whose blanks don't all come before a character that isn't white space.
ODD = re.compile(f" (?:[{UNICODE_SPACE}]|$)|^ |^$")


def _at_blanks(text: str) -> list[str]:
    found = text.split(" ")
    if ODD.search(text) is None:
        return [found[0], *[" " + x for x in found[1:]]]
    made = [found[0]]
    for x in found[1:]:
        if x and x[0] not in UNICODE_SPACE:
            made.append(" " + x)
        else:
            made[-1] += " " + x
    return made if made[0] else made[1:]


def ints(ids: str) -> list[int]:
    return [int(x) for x in ids.split()]


class Codec:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"\S", f"[^{UNICODE_SPACE}]").replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\s", f"[{UNICODE_SPACE}]"))
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self._table("merges", pair=pa.array(pairs, pa.int64()), rank=pa.array(merged, pa.int64()))
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), shown=pa.array([t.hex() for t in ranks], pa.string()))
        #: Ids of pieces, of matches, and of segments and joints of long matches.
        self.known: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.parts: dict[bytes, list[int]] = {}

    def _table(self, name: str, **columns: pa.Array) -> None:
        rows = pa.table(columns)
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, words: list[bytes]) -> list[str]:
        """The decimal ids of distinct words, by the recursive query alone."""
        found: list[str] = []
        lengths = np.array([len(w) for w in words], np.int64)
        # the rows of a word over all rounds are less than the square of its length
        group = np.cumsum(np.minimum(lengths * lengths, WORD_ROWS) + 1) // (WORD_ROWS)
        for some in np.split(np.arange(len(words)), np.flatnonzero(np.diff(group)) + 1):
            n = lengths[some]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            tok = self.single[np.frombuffer(b"".join([words[i] for i in some]), np.uint8)]
            self._table("pending", key=pa.array((np.repeat(np.arange(len(some)), n) << 32) + place), tok=pa.array(tok))
            rows = self.db.sql(CONTRACT).to_arrow_table()
            made = [""] * len(some)
            for w, ids in zip(rows.column("w").to_pylist(), rows.column("ids").to_pylist(), strict=True):
                made[w] = ids
            found += made
        return found

    def learn(self, parts: set[bytes]) -> None:
        """Encodes the segments and joints that aren't known yet."""
        new = sorted(parts - self.parts.keys())
        if new:
            self.parts.update(zip(new, map(ints, self.contract(new)), strict=True))

    def encode_words(self, words: list[bytes]) -> list[str]:
        """The decimal ids of words, each encoded by itself."""
        ranks = self.ranks
        found = [str(ranks[w]) if w in ranks else "" for w in words]
        pending = [i for i, x in enumerate(found) if not x and words[i]]
        short = [i for i in pending if len(words[i]) <= SEGMENT + OVERLAP]
        if short:
            for i, ids in zip(short, self.contract([words[i] for i in short]), strict=True):
                found[i] = ids
        long = [i for i in pending if len(words[i]) > SEGMENT + OVERLAP]
        if long:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            for i in long:
                found[i] = " ".join(map(str, self.encode_long(words[i])))
        return found

    def _fits(self, left: int, right: int) -> bool:
        """True if two tokens encoded together stay as they are."""
        both = self.token[left] + self.token[right]
        self.learn({both})
        return self.parts[both] == [left, right]

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of a long match, from segments joined where their tokens fit."""
        wide, token = SEGMENT + OVERLAP, self.token
        self.learn({word[p : p + wide] for p in range(0, len(word), SEGMENT)})

        def ends(at: int, ids: list[int]) -> list[int]:
            out = []
            for x in ids:
                at += len(token[x])
                out.append(at)
            return out

        # the joints that are tried first, for all segments at once
        places = [ends(p, self.parts[word[p : p + wide]]) for p in range(0, len(word), SEGMENT)]
        joints = set()
        for k in range(len(places) - 1):
            own, other = self.parts[word[k * SEGMENT : k * SEGMENT + wide]], self.parts[word[(k + 1) * SEGMENT : (k + 1) * SEGMENT + wide]]
            where = {e: i for i, e in enumerate(places[k + 1])}
            for i, e in enumerate(places[k]):
                if e in where and where[e] + 1 < len(other):
                    joints.add(token[own[i]] + token[other[where[e] + 1]])
        self.learn(joints)

        done: list[int] = []
        begin, stop = 0, min(wide, len(word))  # of the segment that is being joined to the next
        ids = self.parts[word[:wide]]
        while stop < len(word):
            own = ends(begin, ids)
            start = next_grid = (begin // SEGMENT + 1) * SEGMENT
            joined = None
            while joined is None and start < stop:  # segments of the grid that begin within this one
                other = self.parts[word[start : start + wide]]
                where = {e: i for i, e in enumerate(ends(start, other))}
                for i in range(len(own) - 1, -1, -1):
                    e = own[i]
                    if e in where and where[e] + 1 < len(other) and self._fits(ids[i], other[where[e] + 1]):
                        joined = i, e, start + wide, other[where[e] + 1 :]
                        break
                start += SEGMENT
            for i in range(len(own) - 2, -1, -1) if joined is None else ():  # segments that begin at one's own boundaries
                self.learn({word[own[i] : own[i] + wide]})
                other = self.parts[word[own[i] : own[i] + wide]]
                if own[i] + wide > stop and self._fits(ids[i], other[0]):
                    joined = i, own[i], own[i] + wide, other
                    break
            if joined is None:  # grow
                stop = min(len(word), begin + 2 * (stop - begin))
                ids = ints(self.contract([word[begin:stop]])[0])
                continue
            i, begin, stop, rest = joined
            done += ids[: i + 1]
            ids, stop = rest, min(stop, len(word))
        return done + ids

    def pieces(self, text: str) -> list[str]:
        """Cuts where no match of the pattern reaches across, so that most pieces are single words.

        A blank before a character that isn't white space is the first of a match, and a line break before such a
        character is a match of its own: what comes before either, a run of white space too, matches the same without it.
        """
        if "\n" not in text:
            return _at_blanks(text)
        lines = text.split("\n")
        made: list[str] = []
        held = lines[0]
        for line in lines[1:]:
            if line and line[0] not in UNICODE_SPACE:
                made += _at_blanks(held)
                made.append("\n")
                held = line
            else:
                held += "\n" + line
        return made + _at_blanks(held)

    def encode(self, texts: list[str]) -> list[list[str]]:
        """For each text the runs of decimal ids of its pieces."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.words.clear()
        known, words, cut = self.known, self.words, [self.pieces(x) for x in texts]
        new = list(set().union(*cut).difference(known))
        gc.disable()  # hundreds of thousands of lists without a cycle follow
        matches = [self.pattern.findall(p) for p in new]
        gc.enable()
        unseen = list(set(chain.from_iterable(matches)).difference(words))
        words.update(zip(unseen, self.encode_words([w.encode() for w in unseen]), strict=True))
        for piece, ms in zip(new, matches, strict=True):
            known[piece] = words[ms[0]] if len(ms) == 1 else " ".join([words[m] for m in ms])
        return [list(map(known.__getitem__, ps)) for ps in cut]

    def forget(self) -> None:
        """Gives back the memory of what is remembered."""
        self.known.clear()
        self.words.clear()
        self.parts.clear()

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes that lists of ids stand for; long lists are cut, and their parts put together in order."""
        made = [b""] * len(ids)
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(n) // TOKENS
        for some in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1) if len(ids) else ():
            first, last = int(some[0]), int(some[-1]) + 1
            for at in range(0, max(1, int(n[some].max())), TOKENS):
                part = ids.slice(first, last - first) if n[some].max() <= TOKENS else pc.list_slice(ids.slice(first, last - first), at, at + TOKENS)
                self.db.register("incoming", pa.table({"t": pa.array(range(first, last), pa.int32()), "ids": part}))
                found = self.db.sql(EXPAND).to_arrow_table()
                self.db.unregister("incoming")
                if sum(found.column("n").to_pylist()) != len(pc.list_flatten(part)):
                    raise ValueError("an id is not in the vocabulary")
                for t, shown in zip(found.column("t").to_pylist(), found.column("shown").to_pylist(), strict=True):
                    made[t] += shown
        return made


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def id_lists(ids: pa.Array) -> pa.Array:
    """Strings of decimal ids as lists."""
    return pc.if_else(pc.equal(ids, ""), pa.scalar([], pa.list_(pa.string())), pc.split_pattern(ids, " ")).cast(pa.list_(pa.int32()))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``docs`` but text, and n_tokens and ids (array<int>) of every whole text, which must decode to it.

    No shuffle: each partition by itself.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for part in bounded(batches, ROWS, BYTES):
            texts = [x or "" for x in part.column("text").to_pylist()]
            ids = id_lists(pa.array([" ".join(x) for x in made.encode(texts)], pa.string()))
            if any(x != text.encode() for x, text in zip(made.decode(ids), texts, strict=True)):
                raise ValueError("ids don't decode to their text")
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pc.list_value_length(ids).cast(pa.int64()), ids], [*keep, "n_tokens", "ids"])
        made.forget()  # workers are used again by other operators

    return docs.select(*keep, "text").mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (with ids, array<int>) and ``decoded``, the bytes."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for part in slices(batches, ROWS):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made.decode(part.column("ids")), pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def n_ids(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded and their ids decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for part in bounded(batches, ROWS, BYTES):
            ids = [" ".join(x) for x in made.encode([x or "" for x in part.column("text").to_pylist()])]
            decoded = made.decode(id_lists(pa.array(ids, pa.string())))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n_ids(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
