"""Chat formatting by token-level assembly.

A turn is ``[INST]role\\ntext[/INST]``, an assistant's ``<s>role\\ntext</s>``. Role and text are
encoded separately, never together with the marks; the four marks are reserved ids above the
vocabulary, spliced between the segments. Control strings that occur in a text are escaped by
a backslash after their first character (one more, if backslashes are there already), which
is undone exactly; a role's line breaks are escaped too. The loss mask is a prefix sum over
+1/-1 at the ends of assistant texts (their closing mark is learnt too).

Encoding and decoding run on single rows in parallel. Conversations are put in order by a
sort within partitions and streamed: a conversation of any length is written as chunks of
whole turns, and only its running digests and counts are held.

Null text and null role are empty; rows are ordered by turn (null first), ties by role, then
text; rows with a null conversation id form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, small

MARKS = ["[INST]", "[/INST]", "<s>", "</s>"]
RESERVED = 50300  # ids of the marks, in this order; the vocabulary ends below
CHUNK_TOKENS = 1 << 16
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2] + m[3], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    if t.get_vocab_size() > RESERVED:
        raise ValueError("the reserved ids lie inside the vocabulary")
    return t


def assemble(head: list[int], body: list[int], loss: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a turn from its separately encoded segments."""
    start, end = (RESERVED + 2, RESERVED + 3) if loss else (RESERVED, RESERVED + 1)
    ids = np.concatenate(([start], head, body, [end])).astype(np.int32)
    edge = np.zeros(len(ids) + 1, np.int8)
    if loss:
        edge[1 + len(head)] += 1
        edge[len(ids)] -= 1
    return ids, np.cumsum(edge[:-1]).astype(np.int8)


def _encode(path: str):
    def run(batches):
        t = tokenizer(path)
        for b in small(batches, 128):  # an encoding holds far more than its ids
            roles = [r or "" for r in b.column(2).to_pylist()]
            heads = t.encode_batch([escape_role(r) + "\n" for r in roles], add_special_tokens=False)
            bodies = t.encode_batch([escape(x or "") for x in b.column(3).to_pylist()], add_special_tokens=False)
            made = [assemble(h.ids, x.ids, r == LOSS_ROLE) for h, x, r in zip(heads, bodies, roles, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([i for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8()))],
                names=["conv_id", "turn", "role", "text", "ids", "mask"])

    return run


def _chunks(batches):
    """Sorted turns to (conv_id, chunk, first_token, ids, mask) of whole turns."""
    conv, chunk, first, ids, mask, held, begun = None, 0, 0, [], [], 0, False

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([first], pa.int64()),
             pa.array([np.concatenate(ids)], pa.list_(pa.int32())), pa.array([np.concatenate(mask)], pa.list_(pa.int8()))],
            names=["conv_id", "chunk", "first_token", "ids", "mask"])

    for b in small(batches):
        for c, i, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            i, m = i.values.to_numpy(), m.values.to_numpy()
            if begun and (c != conv or held + len(i) > CHUNK_TOKENS):
                yield row()
                chunk, first = (chunk + 1, first + held) if c == conv else (0, 0)
                ids, mask, held = [], [], 0
            conv, begun, held = c, True, held + len(i)
            ids.append(i)
            mask.append(m)
    if begun:
        yield row()


FORMATTED = "conv_id long, chunk long, first_token long, ids array<int>, mask array<tinyint>"


def format_chats(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turn, role, text) to token chunks with loss masks, in order within a conversation."""
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    coded = base.mapInArrow(_encode(tokenizer_path), "conv_id long, turn long, role string, text string, ids array<int>, mask array<tinyint>")
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "mask")
    return ordered.mapInArrow(_chunks, FORMATTED)


def decode(t, ids: np.ndarray, mask: np.ndarray) -> tuple[list[tuple[str, str]], list[str], int]:
    """Turns, texts under the mask, and code points of the formatted text."""
    turns, learnt, size = [], [], 0
    marks = np.flatnonzero(ids >= RESERVED)
    for a, z in zip(marks[::2], marks[1::2], strict=True):
        whole = t.decode(ids[a + 1 : z].tolist(), skip_special_tokens=False)
        role, _, text = whole.partition("\n")
        turns.append((unescape_role(role), unescape(text)))
        size += len(whole) + len(MARKS[ids[a] - RESERVED]) + len(MARKS[ids[z] - RESERVED])
        under = ids[a + 1 : z][mask[a + 1 : z] > 0]
        if mask[a : z + 1].any():
            learnt.append(unescape(t.decode(under.tolist(), skip_special_tokens=False)))
    return turns, learnt, size


def _decode(path: str):
    def run(batches):
        t = tokenizer(path)
        for b in small(batches, 128):
            rows = []
            for i, m in zip(b.column(2), b.column(3), strict=True):
                turns, learnt, size = decode(t, i.values.to_numpy(), m.values.to_numpy())
                rows.append((len(turns), "".join(f"{r}\n{x}\n" for r, x in turns), "".join(learnt), size))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))],
                names=["conv_id", "chunk", "n_turns", "turns", "learnt", "size"])

    return run


def _digests(batches):
    conv, state, begun = None, None, False

    def row():
        n, turns, chars, loss, size = state
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()),
             pa.array([loss.hexdigest()]), pa.array([size], pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in small(batches):
        for c, _, n, turns, learnt, size in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if begun and c != conv:
                yield row()
            if not begun or c != conv:
                conv, state, begun = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            state[0] += n
            state[1].update(turns.encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += size
    if begun:
        yield row()


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of every conversation, from the token chunks alone."""
    turns = formatted.select("conv_id", "chunk", "ids", "mask").mapInArrow(
        _decode(tokenizer_path), "conv_id long, chunk long, n_turns long, turns string, learnt string, size long")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_round_trip(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_back(materialise(format_chats(rows, tokenizer_path), "chats"), tokenizer_path)


PROBE = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(role) + 1 + length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
