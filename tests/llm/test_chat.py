import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import chat, queries

PARTS = st.sampled_from(["<|", "|>", "<\\|", "</s>", "<s>", "[INST]", "[/INST]", "[\\/INST]", "\\", "é", "\n", "x", "<|end|>\n", "<|turn:user|>\n", ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "", "a|>\nb", "<|"]), st.lists(PARTS, max_size=6).map("".join)), max_size=12))
def test_round_trip(turns):
    turns = sorted(turns, key=lambda t: t[0])
    import numpy as np

    made = chat.format_batch(np.array([t[0] for t in turns], dtype=np.int64), pa.array([t[1] for t in turns], pa.string()), pa.array([t[2] for t in turns], pa.string())).to_pylist()
    for row in made:
        own = [(r, t) for i, r, t in turns if i == row["conv_id"]]
        assert chat.read_back(row["formatted"]) == own
        assert chat.loss_text(row["formatted"], row["loss_starts"], row["loss_ends"]) == "".join(t for r, t in own if r == "assistant")
        assert "<|" not in "".join(chat.escape(pa.array([t])).to_pylist()[0] for _, t in own)


def test_query_against_plain_digests(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(turns)
    for k, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "a", "y"), (1, 1, None, "a", "y"), (None, 0, "user", "n", None), (None, None, "assistant", "m", None), (2, None, "assistant", "y" * 300_000, "z"), (2, 0, "assistant", "", "z")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", ""), ("", "a"), ("", "a")]
    assert chat.read_back(got[None]["formatted"]) == [("assistant", "m"), ("user", "n")]
    assert [len(t) for _, t in chat.read_back(got[2]["formatted"])] == [300_000, 0]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(9) for t in range(c + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "role", "text")
    got = {r["conv_id"]: chat.read_back(r["formatted"]) for r in frame.mapInArrow(chat._format_partition, chat.SCHEMA).collect()}
    assert got == {c: [("user" if t % 2 == 0 else "assistant", f"{c}-{t}") for t in range(c + 1)] for c in range(9)}


def test_the_least_id_is_not_the_null_id(spark):
    rows = [(-(2**63), 0, "user", "a"), (None, 0, "user", "b"), (0, 0, "user", "c"), (None, 1, "assistant", "d")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {-(2**63): 1, None: 2, 0: 1}
