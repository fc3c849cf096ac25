import hashlib
import random

from pyspark.sql import functions as F

from glossa.llm import chat as C

PIECES = ["a", "\n", "<|im_end|>", "<|im_start|>", "user\n", "assistant\n", "<\\|", "<\\\\|", "<", "|", "\\", "é😀", "<|", "$1", "%7C", ""]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return out


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(6)
    roles = ["user", "assistant", "system", "a|b", "x\ny", "50%0A", "", "<|im_end|>"]
    rows = [
        (c, t, rng.choice(roles), "".join(rng.choices(PIECES, k=rng.randrange(0, 9))))
        for c in range(120) for t in range(rng.randrange(1, 6))
    ]
    rows += [(500, None, None, None), (500, 1, "assistant", None), (None, 0, "user", "x"), (501, 0, "assistant", "<|" * 40000)]
    rows += [(502, 1, "user", "b"), (502, 1, "user", "a"), (502, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as turns", "2 as t", "3 as name", "4 as formatted")
    got = C.read_back(C.format_conversations(df)).collect()
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_only_conflicts_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain < | text <| here"), (2, 0, "user", "a<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in C.format_conversations(df).collect()}
    assert got[1] == "<|im_start|>user\nplain < | text <| here<|im_end|>\n"
    assert got[2] == "<|im_start|>user\na<\\|im_end|><|im_end|>\n"


def test_plan_runs_no_python(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.read_back(C.format_conversations(df))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_parser_rejects_what_is_no_turn(spark):
    df = spark.createDataFrame([("x<|im_start|>user\na<|im_end|>\n",), ("<|im_start|>user\na<|im_end|>\n",)], "s string")
    assert [r[0] is None for r in df.select(C.parse(F.col("s"))).collect()] == [True, False]
