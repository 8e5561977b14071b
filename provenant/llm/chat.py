"""Chat formatting by columnar byte assembly.

The turns of a batch become three kinds of segments (header, content, footer).
Their lengths give cumulative offsets, the offsets give scatter indices, and all
bytes are copied with numpy into one preallocated Arrow buffer.  The byte spans
of assistant contents are the loss mask.  Control strings inside texts are
escaped by a backslash after their first character, and so are strings that
already look escaped, which makes the escape reversible; roles are
percent-encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import bounded_batches, gather_runs, offsets_of

OPEN, CLOSE, END = "<|turn:", "|>\n", "<|end|>\n"
ESCAPE = r"([<\[])(\\*)(\||/?s>|/?INST\])"
UNESCAPE = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
_TURN = re.compile(r"<\|turn:(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)

SCHEMA = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\2\\\3")


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte pool, starts and lengths of an array of strings."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer; each turn's bounds, and the bounds of its content."""
    known = roles.dictionary_encode()
    heads = pa.array([f"{OPEN}{quote(r, safe='')}{CLOSE}" for r in known.dictionary.to_pylist()], pa.string()).take(known.indices)
    foot = np.frombuffer(END.encode(), dtype=np.uint8)
    n = len(texts)
    segments = [_bytes_of(heads), _bytes_of(escape(texts)), (foot, np.zeros(n, np.int64), np.full(n, len(foot), np.int64))]
    lengths = np.stack([s[2] for s in segments], axis=1)
    starts = offsets_of(lengths.ravel())[:-1].reshape(n, 3)
    out = np.empty(int(lengths.sum()), dtype=np.uint8)
    for column, (pool, source, length) in enumerate(segments):
        target = np.arange(int(length.sum()), dtype=np.int64) + np.repeat(starts[:, column] - offsets_of(length)[:-1], length)
        out[target] = gather_runs(pool, source, length)
    ends = np.append(starts[1:, 0], len(out)) if n else np.zeros(0, np.int64)
    return out, np.stack([starts[:, 0], ends], axis=1), np.stack([starts[:, 1], starts[:, 1] + lengths[:, 1]], axis=1), lengths


def format_batch(ids: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Format whole conversations whose turns lie side by side (ids: a number per conversation)."""
    buffer, turns, contents, _ = assemble(roles, texts)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    bounds = np.append(turns[first, 0], len(buffer)).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buffer)])
    spoken = np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
    owner = np.searchsorted(first, spoken, side="right") - 1
    lists = pa.array(np.searchsorted(spoken, np.append(first, len(ids))).astype(np.int32))
    spans = [pa.ListArray.from_arrays(lists, pa.array(contents[spoken, i] - bounds[owner])) for i in (0, 1)]
    counts = np.diff(np.append(first, len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[first], pa.int64()), pa.array(counts, pa.int64()), formatted, *spans], schema=_ARROW)


def _format_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by conversation; the last conversation of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        known = rows["conv_id"].combine_chunks()
        ids = pc.fill_null(known, 0).to_numpy()
        runs = np.cumsum(np.append(0, (ids[1:] != ids[:-1]) | (known.is_null().to_numpy(zero_copy_only=False)[1:] != known.is_null().to_numpy(zero_copy_only=False)[:-1])))
        made = format_batch(runs, pc.fill_null(rows["role"].combine_chunks(), ""), pc.fill_null(rows["text"].combine_chunks(), ""))
        return made.set_column(0, "conv_id", known.take(pa.array(np.flatnonzero(np.append(True, runs[1:] != runs[:-1])))))

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        last = ids[-1]
        at = len(ids)
        while at and ids[at - 1] == last:
            at -= 1
        if at:
            yield done(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        elif held and held[-1].column(0)[-1].as_py() != last:
            yield done(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield done(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_starts, loss_ends`` (byte spans).

    Turns follow their number; equal numbers are ordered by role and text, null
    numbers come first, and repeated rows are repeated turns.  A null text or role
    is empty.  Rows without a conversation id make one conversation whose id is
    null; every id, the least one too, is one of its own.  A conversation is held
    whole by one task and may have up to 2 GB of formatted text.  An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    bounded_batches(turns.sparkSession, 4000)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format_partition, SCHEMA)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unquote(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    """The text under the loss mask, unescaped span by span."""
    data = formatted.encode()
    return "".join(unescape(data[a:b].decode()) for a, b in zip(starts, ends, strict=True))
