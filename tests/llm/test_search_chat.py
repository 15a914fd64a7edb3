import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zygospan.llm import chat, topk


def test_topk_equals_brute_force(spark):
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    data += [(i + 300, data[i % 5][1]) for i in range(40)]  # ties
    data += [(900, None), (901, []), (1000, [0.0] * 6), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, [1.0, 2.0]), (1401, [3.0, 4.0]), (None, [1.0] * 6), data[100]]
    import math
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in {q: a for q, a in ok}.items():
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for block in (8192, 50):
        got = topk.top_k(df, df.filter("vec_id % 100 = 0"), block=block, query_block=2).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    none = df.filter("false")
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(df, none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]\n", "</s>", "tool\nx", "\n", "a\\", "user\n"]), st.text(alphabet="<s>/[]INTROLEY\\ \nab", max_size=40)), max_size=6))
def test_formatted_turns_read_back(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_paths_of_reply_trees(spark):
    rng = random.Random(3)
    rows = []
    for conv in (1, 2, None):
        for n in range(60):
            parent = None if n == 0 or n == 30 else n - 1 if n < 20 else rng.randrange(n)
            rows.append((conv, n, parent, rng.choice(["user", "assistant", None]), rng.choice([None, "", f"t{n} </s>"]), rng.choice([None, float(n)])))
    rows.append((3, 5, 77, "user", "orphan", 1.0))  # its parent is missing
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    at = {(c, n): (p, r or "", t or "", s or 0.0) for c, n, p, r, t, s in rows}
    parents = {(c, p) for c, _, p, *_ in rows}
    want = {}
    for c, n in at:
        if (c, n) not in parents:
            path, k = [], n
            while k is not None and (c, k) in at:
                path.append(at[c, k])
                k = at[c, k][0]
            want[c, n] = (chat.render([(r, t) for _, r, t, _ in path[::-1]])[0], sum(s for *_, s in path))
    got = chat.format_conversations(df).collect()
    assert {(r.conv_id, r.leaf): (r.formatted, r.score) for r in got} == want and len(got) == len(want)
    ranks = {c: [n for _, n in sorted((-s, n) for (d, n), (_, s) in want.items() if d == c)] for c, _ in want}
    assert all(ranks[r.conv_id][r.branch - 1] == r.leaf for r in got)
    top = chat.format_conversations(df, best=2).filter("conv_id = 1").orderBy("branch").collect()
    assert [(r.branch, r.leaf) for r in top] == [(i + 1, n) for i, (n, _) in enumerate(sorted(((n, s) for (c, n), (_, s) in want.items() if c == 1), key=lambda x: (-x[1], x[0]))[:2])]


def test_a_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "conv_id long, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="cycle"):
        chat.format_conversations(df).collect()


def test_digests_read_from_the_output(spark):
    rows = [(1, 1, "assistant", "b </s> \\"), (1, 0, "user", "a [INST]"), (1, 2, "tool", None), (None, 0, "assistant", "x"), (4, None, None, None), (5, 0, "user", "s"), (5, 0, "user", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.from_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na [INST]\nassistant\nb </s> \\\ntool\n\n") and got[1].loss_sha256 == sha("b </s> \\") and got[1].n_turns == 3
    assert got[None].loss_chars == 1 and got[4].n_turns == 1 and got[4].loss_sha256 == sha("") and got[5].n_turns == 2
    assert chat.digests(chat.format_conversations(chat.from_turns(df.filter("false")))).count() == 0
