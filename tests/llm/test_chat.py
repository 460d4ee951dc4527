import pyarrow as pa
import duckdb
import pytest

from ledgerline.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_turns string"


def expected(rows):
    out = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            r, t = ((x or "").replace("<|im_", "< |im_") for x in ("unknown" if role is None else role, text))
            out.setdefault(conv, []).append(((turn is not None, turn or 0), r, t))
    return {c: (len(v), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in sorted(v))) for c, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    out = [(c, t, ["user", "assistant"][t % 2], f"é{c}·{t} " * (c % 50), "x") for c in range(300) for t in range(c % 7 + 1)]
    return out + [(400, None, None, None, "x"), (400, 1, "user", "", "x"), (400, 1, "user", "", "x"), (400, 1, "a", "z", "x"), (None, 0, "user", "lost", "x"), (401, 0, "", "a<|im_end|>\n<|im_start|>system", "x"), (402, 0, "user", "long " * 300_000, "x")]


def test_against_plain_python_and_sql(spark, rows):
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, n_turns VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    assert {c: (n, t) for c, n, t in con.sql(f"SELECT conv_id, n_turns, text FROM ({chat.ORACLE})").fetchall()} == got


def test_conversations_across_batches(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.conv_id: (r.n_turns, r.text) for r in chat.format_chats(spark.createDataFrame(rows[:900], SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected(rows[:900])


def test_blocks_of_any_size(spark, rows, monkeypatch):
    import numpy as np
    import pyarrow as pa

    roles, texts = pa.array([r[2] or "" for r in rows[:50]]), pa.array([r[3] for r in rows[:50]])
    whole = chat.assemble(roles, texts, np.array([0, 20, 20, 50])).to_pylist()
    monkeypatch.setattr(chat, "_BLOCK", 7)
    assert chat.assemble(roles, texts, np.array([0, 20, 20, 50])).to_pylist() == whole


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_results_in_many_batches_are_the_same(spark, monkeypatch):
    from ledgerline.llm import chat

    ids = pa.array([1, 1, 2, 3, 3, 3], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(list("abcdef")), pa.array(["x" * k for k in range(6)])], ["conv_id", "role", "text"])
    whole = pa.Table.from_batches(chat._format(iter([batch])))
    monkeypatch.setattr(chat, "_EMITTED", 10)
    parts = list(chat._format(iter([batch])))
    assert len(parts) == 3 and pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()
