"""Chat formatting against a plain version."""

from collections import defaultdict

from tabloom.llm import chat
from tabloom.llm.common import table

TURN = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(tuple(r[1:]))
    key = lambda t: tuple((v is not None, v) if v is not None else (False, 0) for v in t)
    bodies = {c: tuple(t[1:] for t in sorted(turns, key=key)) for c, turns in convs.items()}
    out = {}
    for c, body in bodies.items():
        same = [d for d in bodies if bodies[d] == body]
        if any(len(b) > len(body) and b[: len(body)] == body for b in bodies.values()) or c != min((d for d in same if d is not None), default=None):
            continue
        out[c] = (len(body), len(same), "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in body))
    return out


def check(df):
    found = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.render(df).collect()}
    assert found == plain(df.select("conv_id", "turn", "role", "text").collect())
    return found


def test_small_table(spark, sf_dir):
    assert check(table(spark, sf_dir, "conversations"))


def test_snapshots_copies_nulls_ties(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 5, "user", "hi"), (3, 9, "assistant", "yes"), (3, 11, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"),
        (6, 0, None, "x"), (7, 0, "x", None), (8, 0, "", "x"), (9, None, "user", ""), (10, None, "user", None),
        (None, 0, "user", "lost"), (None, 1, "user", "rows"), (11, 0, "user", "lost"), (12, 0, "user", "tie"), (12, 0, "user", "tie"), (13, 0, "user", "tie"),
        (14, 0, "user", "long " * 5000),
    ]
    df = spark.createDataFrame(rows, TURN).selectExpr("*", "1 AS n", "2 AS k", "3 AS a", "4 AS n_copies")
    found = check(df)
    assert 3 in found and 1 not in found and 2 not in found and found[4][1] == 2 and 5 not in found and 11 not in found and 13 not in found


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], TURN)).count() == 0
