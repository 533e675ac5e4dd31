"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one DuckDB instance per Python worker.

Text is split by the public pattern on the JVM (a text with characters on which its tables could differ from the tokenizer's
is split in Python instead). Each distinct word of a chunk that the worker hasn't met yet becomes token-position rows; a
recursive query joins them with the merge table and contracts each word's leftmost minimum-rank pair until no pair is left.
All occurrences of that pair in a word are contracted in one round where contracting them one by one would give the same: if no
merge of the contracted token, with whatever neighbour, has a smaller rank. So the rounds of a word are bounded by the number of
different ranks in it, and only the last state of each row is kept: memory grows with the bytes of a batch, not with rounds.
Decoding joins ids with the vocabulary and aggregates their bytes in order of position.

Words are taken in batches of bounded size by length, a longer word alone; texts in chunks, a longer text in pieces. The words
of a task are kept up to a bound, and those that came again, up to a smaller one, for the worker's next task.

Defined results: a null text is empty: no tokens and digests of the empty string; texts and words of any length are encoded whole;
repeated rows each get a result; columns but the id and the text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, table

#: Vocabulary and pattern of the query; the operators take them as parameters.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of text encoded together, words kept during a task and after it, and bytes of words merged by one query, at most.
CHUNK_CHARS, KEPT_WORDS, RESTING_WORDS, BATCH_BYTES = 4_000_000, 600_000, 300_000, 300_000
#: What an instance may use. A batch takes about a tenth, a word of a million bytes most of it.
MEMORY = "768MB"
#: Ends each word of a text that the JVM has split. Texts that hold it are split in Python.
_CUT = "\0"
#: Characters outside the basic plane or unassigned in the JVM's tables.
_UNSURE = r"[\x00\x{10000}-\x{10FFFF}\p{Cn}]"
# The White_Space property, which \s means in the tokenizer and not in the JVM.
_SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"

#: How a pair is contracted: all its occurrences in a word; every second one of a run of them, as those overlap; the first one.
ALL, EVERY_SECOND, FIRST = 0, 1, 2
# start(p, w, tok, np): place, word, token and place of the next one. code is 4 * rank + how, so that the smallest code is the
# smallest rank. A token that has gone into another becomes -1.
_ENCODE = f"""
with recursive step(p, w, tok, np) using key (p) as (
  select p, w, tok, np from start
  union all
  (with pairs as (select s.w, s.p, s.np, n.np as after, m.code from step s join step n on n.p = s.np join merges m on m.pair = s.tok * 65536::bigint + n.tok),
   best as (select w, min(code) as code from pairs group by w),
   hits as (select h.*, row_number() over (partition by h.w order by h.p) as k from pairs h join best b on h.w = b.w and h.code = b.code),
   chosen as (
     select p, np, after, code // 4 as tok from hits where code % 4 = {ALL} or code % 4 = {FIRST} and k = 1
     union all select p, np, after, code // 4 from (select *, row_number() over (partition by w, p - k * (np - p) order by p) as turn from hits where code % 4 = {EVERY_SECOND}) where turn % 2 = 1),
   changed as (select p, tok, after as np from chosen union all select np, -1, -1 from chosen)
   select s.p, s.w, coalesce(c.tok, s.tok), coalesce(c.np, s.np) from step s join best b on s.w = b.w left join changed c on c.p = s.p where s.tok >= 0)
)
select w, string_agg(tok::varchar, ' ' order by p) as ids, string_agg(piece, '' order by p) as text
from step join vocabulary on id = tok where tok >= 0 group by w order by w
"""
_DECODE = "select w, string_agg(piece, '' order by pos) as text from ids join vocabulary using (id) group by w order by w"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 bytes, then the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """The vocabulary in a DuckDB instance with one thread."""

    def __init__(self, data: bytes, memory: str = MEMORY):
        self.ranks, self.memory = read_ranks(data), memory
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        found = []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    found.append((left, right, rank))
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        # Tokens that a neighbour could take up at a smaller rank than their own: such a merge would come before other occurrences.
        early = np.union1d(left[rank < left], right[rank < right])
        how = np.where(np.isin(rank, early), FIRST, np.where(left == right, EVERY_SECOND, ALL))
        self.merges = pa.table({"pair": pa.array(left * 65536 + right), "code": pa.array((4 * rank + how).astype(np.int32))})
        self.db = None
        self.resting = ("", "")
        self.wake()

    def wake(self) -> None:
        """Before a task: the instance, and the words that the worker's last task left."""
        import duckdb

        #: The ids of each word that is kept; what they decode to, where that isn't the word's own bytes; words that came again.
        self.words: dict[str, str] = dict(zip(*(x.split(_CUT) for x in self.resting))) if self.resting[0] else {}
        self.differ: dict[str, bytes] = {}
        self.again: set[str] = set(self.words)
        if self.db is None:
            self.db = duckdb.connect(config={"threads": 1, "memory_limit": self.memory, "temp_directory": ""})
            self._fill("merges", self.merges)
            self._fill("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array([t.hex() for t in self.ranks])}))

    def rest(self) -> None:
        """After a task, as a worker lives on, for other operators' tasks too: only words that came again are left, in one piece."""
        left = [w for w in self.again if w in self.words and w not in self.differ and _CUT not in w]
        left = left if len(left) <= RESTING_WORDS else []
        self.resting = _CUT.join(left), _CUT.join(self.words[w] for w in left)
        self.forget()
        self.db.close()
        self.db = None
        pa.default_memory_pool().release_unused()

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def merge_words(self, words: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Their token ids, written out, and the bytes that these decode to."""
        if not words:
            return [], []
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        tok = self.first[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(len(tok), dtype=np.int32)
        after = place + 1
        after[ends - 1] = -1
        self.db.register("start", pa.table({"p": place, "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "tok": tok, "np": after}))
        found = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("start")
        return found["ids"].to_pylist(), [bytes.fromhex(x) for x in found["text"].to_pylist()]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation."""
        w = [i for i, x in enumerate(ids) for _ in x]
        pos = [k for x in ids for k in range(len(x))]
        self.db.register("ids", pa.table({"w": pa.array(w, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array([t for x in ids for t in x], pa.int32())}))
        out = [b""] * len(ids)
        for i, text in self.db.sql(_DECODE).fetchall():
            out[i] = bytes.fromhex(text)
        self.db.unregister("ids")
        return out

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that aren't kept yet."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        self.again |= words & self.words.keys()
        new = [(w, w.encode()) for w in words if w not in self.words]
        whole = [(w, raw) for w, raw in new if raw in self.ranks]
        for (w, raw), decoded in zip(whole, self.decode([[self.ranks[raw]] for _, raw in whole])):
            self._keep(w, raw, str(self.ranks[raw]), decoded)
        parts = sorted(((w, raw) for w, raw in new if raw not in self.ranks), key=lambda x: len(x[1]))
        at = 0
        while at < len(parts):
            end, size = at + 1, len(parts[at][1])
            while end < len(parts) and size + len(parts[end][1]) <= BATCH_BYTES:
                size += len(parts[end][1])
                end += 1
            some = parts[at:end]
            for (w, raw), ids, decoded in zip(some, *self.merge_words([raw for _, raw in some])):
                self._keep(w, raw, ids, decoded)
            at = end

    def _keep(self, word: str, raw: bytes, ids: str, decoded: bytes) -> None:
        self.words[word] = ids
        if decoded != raw:
            self.differ[word] = decoded

    def forget(self) -> None:
        self.words.clear()
        self.differ.clear()
        self.again.clear()

    def decoded(self, words: list[str]) -> bytes:
        """What the ids of a text, encoded before, decode to: each word's own bytes, as learn() has compared, unless differ has others."""
        if self.differ:
            return b"".join(self.differ[w] if w in self.differ else w.encode() for w in words)
        return "".join(words).encode()


_codecs: dict[str, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One per vocabulary and worker process, so that the merge table is built once for its tasks."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def _with_spaces(pattern: str) -> str:
    """The pattern with its white space written out."""
    return pattern.replace(r"\S", "[^" + _SPACE + "]").replace(r"[^\s", "[^" + _SPACE).replace(r"\s", "[" + _SPACE + "]")


def splitter(pattern: str):
    """Words of a row's text, cut by the JVM or here, in lists of about CHUNK_CHARS characters."""
    import regex

    compiled = regex.compile(_with_spaces(pattern))

    def split(text: str, cut: bool) -> Iterator[list[str]]:
        if len(text) <= CHUNK_CHARS:
            yield text.split(_CUT)[:-1] if cut else compiled.findall(text)
        elif cut:
            at = 0
            while at < len(text):
                end = text.find(_CUT, at + CHUNK_CHARS) + 1 or len(text)
                yield text[at:end].split(_CUT)[:-1]
                at = end
        else:
            words, size = [], 0
            for m in compiled.finditer(text):
                words.append(m[0])
                size += len(m[0])
                if size >= CHUNK_CHARS:
                    yield words
                    words, size = [], 0
            yield words

    return split


def with_cuts(docs: DataFrame, pattern: str, text_col: str, id_col: str) -> DataFrame:
    """(id, text, cut): text has a mark after each word if cut."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = ~text.rlike(_UNSURE)
    return docs.select(F.col(id_col).alias("id"), F.when(cut, F.regexp_replace(text, _with_spaces(pattern), "$0" + _CUT)).otherwise(text).alias("text"), cut.alias("cut"))


class Digest:
    """Number and digests of a text's tokens, from its words in order."""

    FIELDS = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, codec: Codec, words: list[str]) -> None:
        if words:
            ids = " ".join(map(codec.words.__getitem__, words))
            self.ids.update((" " + ids if self.n else ids).encode())
            self.text.update(codec.decoded(words))
            self.n += ids.count(" ") + 1

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class Ids:
    """A text's tokens."""

    FIELDS = {"ids": ("array<int>", pa.list_(pa.int32()))}

    def __init__(self):
        self.ids: list[int] = []

    def add(self, codec: Codec, words: list[str]) -> None:
        self.ids += [int(x) for w in words for x in codec.words[w].split()]

    def row(self) -> tuple:
        return (self.ids,)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of about CHUNK_CHARS characters together; a longer text alone."""
    rows, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 128).columns)):
                if rows and size + len(row[1]) > CHUNK_CHARS:
                    yield rows
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
    if rows:
        yield rows


def _encoded(docs: DataFrame, data: bytes, pattern: str, id_col: str, text_col: str, what: type) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(data)  # the vocabulary file: its size is fixed
    kind = docs.schema[id_col].dataType.simpleString()
    names, types = [id_col, *what.FIELDS], [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind], *(t for _, t in what.FIELDS.values())]

    def run(batches):
        codec, split = codec_of(shared.value), splitter(pattern)
        codec.wake()
        for rows in _chunks(batches):
            found = []
            texts = [split(text, cut) for _, text, cut in rows]
            if len(rows) > 1:  # each is a single list, and all are learned together
                texts = [list(x) for x in texts]
                codec.learn(set().union(*(words for lists in texts for words in lists)))
            for (i, _, _), lists in zip(rows, texts):
                one = what()
                for words in lists:
                    if len(rows) == 1:
                        codec.learn(set(words))
                    one.add(codec, words)
                found.append((i, *one.row()))
            for at in range(0, len(found), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[at : at + 256]), types)], names=names)
        codec.rest()

    return with_cuts(docs, pattern, text_col, id_col).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {t}" for n, (t, _) in what.FIELDS.items())]))


def encode_documents(docs: DataFrame, data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the tokens of each whole text. data: the rank file."""
    return _encoded(docs, data, pattern, id_col, text_col, Ids)


def decode_documents(encoded: DataFrame, data: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of each row's ids, by ordered aggregation."""
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = codec_of(shared.value)
        codec.wake()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = codec.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=[id_col, "bytes"])
        codec.rest()

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def token_digests(docs: DataFrame, data: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded word by word."""
    return _encoded(docs, data, pattern, id_col, text_col, Digest)


def public_vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """The rank file's bytes, read on the driver, and the pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *public_vocabulary())
