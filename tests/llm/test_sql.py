"""Queries that SQL can express against DuckDB, on tables with nulls, empty and long texts, ties, repeats, and none."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest

from weftline.llm import queries

PROSE = {"en": "the of and to in is that for it was on are house tree walked seven", "fr": "de la le et les des en un du une maison arbre marche", "xx": "zu qa ri mo te"}


def documents():
    rng = random.Random(3)
    rows = []
    for i in range(70):
        lang = rng.choice([*PROSE, "en"])
        words = [rng.choice(PROSE[lang].split()) for _ in range(rng.randrange(1, 160))]
        text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\t", "É ", "#9 "]) for w in words)
        if i % 6 == 5:
            text = (rows[-1]["text"] or "")[rng.randrange(30) :] + text
        if i % 11 == 7:
            text = text.upper() + "#$%&" * 90
        rows.append({"doc_id": i * 2, "text": text, "lang": lang, "source": "s", "n_chars": 0})
    odd = [(1, None, "en"), (3, "", None), (5, " \n\t ", "fr"), (7, "é" * 3000, "en"), (9, "é" * 3001, None), (11, "the end of it\n" * 4000, "en"), (13, "one two", ""), (13, "one two", "")]
    return pa.Table.from_pylist([*rows, *[{"doc_id": i, "text": t, "lang": g, "source": None, "n_chars": None} for i, t, g in odd]])


def embeddings():
    rng = random.Random(4)
    rows, last = [], [1.0] * 8
    for i in range(90):
        last = [x + rng.gauss(0, 0.2) for x in last] if i % 7 else [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i * 3, last))
    rows += [(1, None), (2, []), (4, [0.0] * 8), (5, [float("nan")] + [1.0] * 7), (7, [None] + [1.0] * 7), (8, rows[5][1]), (10, [2 * x for x in rows[5][1]]), (11, [1.0, 2.0])]
    return pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def conversations():
    rng = random.Random(5)
    texts = ["hi", "", None, "a <s> b [INST] \\ c", "[/ROLE]\\\\", "é\nü" * 900]
    rows = [{"conv_id": rng.choice([1, 2, 3, 4, None]), "turn": rng.choice([0, 1, 2, 3, 4, None]), "role": rng.choice(["user", "assistant", "system", "tool", "x[TEXT]", None]), "text": rng.choice(texts)} for _ in range(60)]
    rows += [{"conv_id": 9, "turn": t, "role": r, "text": "ok"} for t, r in enumerate(["system", "user", "assistant", "tool", "assistant"])]
    return pa.Table.from_pylist(rows)


TABLES = {"documents": documents(), "embeddings": embeddings(), "conversations": conversations()}
USED = {"op1_embedding_dedup": "embeddings", "op3_chat_format": "conversations", "op5_quality_rules": "documents", "op8_suffix_dedup": "documents"}


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(columns), sorted(tuple(f"{r[k]:.6f}" if isinstance(r[k], float) else str(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, tmp_path, name, empty):
    duck = duckdb.connect()
    table = TABLES[USED[name]]
    table = table.slice(0, 0) if empty else table
    pa.parquet.write_table(table, tmp_path / f"{USED[name]}.parquet")
    duck.execute(f"create view {USED[name]} as select * from '{tmp_path}/{USED[name]}.parquet'")
    expected = duck.execute(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, str(tmp_path))
    assert rows_of(found.columns, found.collect()) == rows_of([d[0] for d in expected.description], expected.fetchall())
