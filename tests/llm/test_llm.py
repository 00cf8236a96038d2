import itertools
import os
import random
import unicodedata
from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, disguise, mixing, packing, queries, stuffing, survivors, terms, tokens
from verify import rows_of

# ---- SQL -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.ORACLE:
        db = duckdb.connect()
        for f in os.listdir(tiny):
            db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{tiny}/{f}')")
        cur = db.execute(queries.ORACLE[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


# ---- survivors ---------------------------------------------------------------------------

RECORDS = "row_id long, id string, auth array<struct<type:string,location:string,name:string,source:string,confidence:double>>, provenance array<struct<source_id:string,source_url:string,revision:string,retrieved_at:string,content_hash:string,license:string>>, last_checked_at string, rights map<string,string>, ingested_at timestamp, status string, https string, cors string, source_tier string"


def test_survivors(spark):
    now = datetime(2026, 1, 1)
    a = lambda *ts: [(t, "header", "", "s", 1.0) for t in ts]
    p = lambda h: [("s", "u", "r", "2025-01-01T00:00:00Z", h, None)]
    rows = [
        (1, "x", a("none"), p("a" * 64), "2025-01-01T00:00:00Z", {"a": "v"}, now, "active", "yes", None, "public"),
        (2, "x", a("basic", "basic", "unknown"), p("short"), "2025-01-01T05:00:00+05:30", {"a": "v", "b": "TBD"}, now, None, None, None, None),
        (3, "x", None, None, "2030-01-01T00:00:00Z", {"a": "n/a"}, now, None, None, None, None),
        (4, "y", a("unknown"), None, None, None, now, None, None, None, None),
        (5, "y", None, None, "", {}, None, None, None, None, None),
        (6, "z", a("basic"), None, None, None, now, None, None, None, None),
        (7, None, a("basic"), None, None, None, now, None, None, None, None),
        (8, None, a("basic"), None, None, None, now, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumns({"field": F.lit(1), "__n": F.lit(2)})
    got = {(r.id, r.field): r.row_id for r in survivors.catalog_survivors(df).collect()}
    assert got == {("x", "auth"): 1, ("x", "last_checked_at"): 1, ("x", "provenance"): 1, ("x", "rights"): 1}
    assert survivors.catalog_survivors(df.limit(0)).count() == 0


def test_learned_order(spark):
    rows = [(10 * g + k, f"g{g}", v, at) for g in range(5) for k, (v, at) in enumerate([("candidate", 1), ("active", 2), ("stale", 3)])]
    rows += [(100, "h", "candidate", 5), (101, "h", "active", None), (102, "i", "stale", None), (103, "i", "active", None), (104, "j", "stale", 4), (105, "j", "candidate", None), (106, "k", "odd", 1), (107, None, "active", 1)]
    df = spark.createDataFrame(rows, "row_id long, id string, status string, at long")
    domain = {"status": ["candidate", "active", "stale"]}
    votes = {(r.a, r.b): r.votes for r in survivors.transitions(df, "id", F.col("at"), domain).collect()}
    assert votes == {("candidate", "active"): 5, ("active", "stale"): 5, ("candidate", "stale"): 5}
    got = {r.id: (r.value, r.row_id, r.basis) for r in survivors.current_values(df, "id", "row_id", F.col("at"), domain).collect()}
    assert got["h"] == ("active", 101, "learned")
    assert got["i"] == ("stale", 102, "learned")
    assert got["j"] == ("stale", 104, "dated")
    assert got["g0"] == ("stale", 2, "dated") and "k" not in got and None not in got


def test_precedence_has_no_circles():
    after = survivors.precedence([("f", "a", "b", 5), ("f", "b", "c", 4), ("f", "c", "a", 3), ("f", "b", "a", 2)])
    assert after == {"f": {"a": {"b", "c"}, "b": {"c"}}}


def test_declared_order_holds():
    votes = [("f", 2, 1, 50), ("f", 0, 2, 7), ("f", 3, 0, 9), ("g", "b", "a", 3)]
    assert survivors.precedence(votes, [("f", n, n + 1) for n in range(3)]) == {"f": {0: {1, 2, 3}, 1: {2, 3}, 2: {3}}, "g": {"b": {"a"}}}


def test_survivors_against_the_rule(spark, monkeypatch):
    """The row that comes out of the graph is that of the declared rule, whatever the votes; more knowledge than the graph has states is told apart."""
    monkeypatch.setattr(survivors, "MOST_STATES", 3)
    r = random.Random(8)
    rows = [(k, r.choice(["a", "a", "b", "c", None]), r.choice([None, 0, 1, 2, 3, 4, 9]), r.choice([None, 1, 2, 3])) for k in range(300)] + [(900, "alone", 5, 1), (901, "none", 0, 1), (902, "none", None, 2)]
    df = spark.createDataFrame(rows, "row_id long, id string, s int, at long")
    got = {(x.id, x.field): x.row_id for x in survivors.survivors(df, "id", "row_id", F.col("at"), {"f": F.col("s"), "g": -F.col("s") + 9}).collect()}
    want = {}
    for field, score in (("f", lambda x: x[2] or 0), ("g", lambda x: 0 if x[2] is None else 9 - x[2])):
        for g in ("a", "b", "c", "alone", "none"):
            of = [x for x in rows if x[1] == g]
            best = max(of, key=lambda x: (score(x), x[3] if x[3] is not None else -1, -x[0]))
            if len(of) > 1 and score(best) > 0:
                want[g, field] = best[0]
    assert got == want


def test_survivors_learn_nothing(spark):
    """The declared order leaves no two rows open: rows are read and shuffled once, no job runs before the result's own."""
    rows = [(1, "x", 1, 5), (2, "x", 2, 4), (3, "y", 2, 3), (4, "y", 1, 9), (5, "z", 1, None), (6, "z", 1, 7), (8, "w", 1, 7), (7, "w", 1, 7)]
    df = spark.createDataFrame(rows, "row_id long, id string, s int, at long")
    sc = spark.sparkContext
    sc.setJobGroup("survivors", "")
    try:
        out = survivors.survivors(df, "id", "row_id", F.col("at"), {"f": F.col("s")})
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        assert list(sc.statusTracker().getJobIdsForGroup("survivors")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert {r.id: r.row_id for r in out.collect()} == {"x": 2, "y": 3, "z": 6, "w": 7}


# ---- terms -----------------------------------------------------------------------------------


def test_terms(spark):
    rows = [(1, "a", "Alpha alpha ONE", None, ["x"], None), (2, "a", "alpha private private private", "", [], []), (3, "b", "one alpha beta", None, None, ["beta"]), (4, None, "beta  ünique_beta", None, [None], None), (5, "c", None, None, None, None), (6, "d", "gamma alpha " * 5000, None, None, None)]
    df = spark.createDataFrame(rows, "row_id long, id string, name string, description string, tags array<string>, categories array<string>")
    freq = {r.term: r.df for r in terms.document_frequencies(df, "id", terms.record_text(df)).collect()}
    assert freq == {"alpha": 3, "one": 2, "x": 1, "private": 1, "beta": 1, "gamma": 1}
    probes = spark.createDataFrame([(1,), (2,), (4,), (5,), (99,), (1,)], "row_id long")
    got = {r.row_id: r.term for r in terms.most_distinctive(df, probes).collect()}
    assert got == {1: "one", 2: "alpha", 4: "beta"}
    assert terms.most_distinctive(df.limit(0), probes).count() == 0


def test_frequencies_of_heavy_keys(spark, monkeypatch):
    df = spark.createDataFrame([("h" if k % 3 else f"k{k}", f"w{k % 7} common") for k in range(60)], "id string, name string")
    want = sorted(map(tuple, terms.document_frequencies(df, "id", F.col("name")).collect()))
    monkeypatch.setattr(terms, "heavy_keys", lambda d, k: [("h",)])
    assert sorted(map(tuple, terms.document_frequencies(df, "id", F.col("name")).collect())) == want


# ---- disguise ---------------------------------------------------------------------------------

SOUND = ["naïve café", "Погода сегодня", "Χάρτης πόλης", "β-free", "می‌خواهم", "👩‍💻 and 👨‍👩‍👧", "m² ½ № beta™ → €", "“open” it’s 24–48", "プログラム表 데이터 목록", "天气查询，行情。", "Thời tiết", "API接口", "क्‍ष", "", "plain", "a\tb\nc"]
DISGUISED = {
    "ｗｅａｔｈｅｒ": "weather", "naïve": "naïve", "da​ta": "data", "a b": "a b", "gаmеs": "games", "ﬁeld": "field", "soft­hyphen": "softhyphen", "a‑b": "a-b", "﻿x": "x", "or‍": "or", "servinɡ": "serving",
    "Tời": "Tời", "ガ": "ガ", "⽓": "气", "bօundary": "boundary", "Кaталог": "Каталог", "n‎a": "na", "x　y": "x y", "e​́": "é", "Αpi": "Api", "ok．": "ok.",
}


def test_plain_form():
    for s in SOUND:
        assert disguise.plain_form(s) == s, s
    for a, b in DISGUISED.items():
        assert disguise.plain_form(a) == unicodedata.normalize("NFC", b), (ascii(a), ascii(disguise.plain_form(a)))
    assert disguise.plain_form(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe аеѕορ́̈​‍ ｅＡ气⽓ガ゙‑👩💻می é-1，."), max_size=12))
def test_plain_form_is_stable(s):
    once = disguise.plain_form(s)
    assert disguise.plain_form(once) == once


def test_numerals_in_words():
    assert disguise.plain_form("ⅽat ⅿusic") == "cat music"
    assert disguise.plain_form("Ⅷ ⅽ Ⅻ") == "Ⅷ ⅽ Ⅻ"  # alone they are numerals


def test_disguised(spark):
    rows = [(1, "ｗ", None, ["a​", "b​", None]), (2, "ok", "é", None), (3, None, "x " * 50_000, []), (4, "é", "n", ["天气"])]
    df = spark.createDataFrame(rows, "row_id long, name string, description string, aliases array<string>").withColumn("field", F.lit(1))
    got = sorted((r.field, r.row_key) for r in disguise.disguised(df, "row_id", ["name", "description", "aliases"]).collect())
    assert got == [("aliases", 1), ("description", 3), ("name", 1)]
    assert disguise.disguised(df.limit(0), "row_id", ["name"]).count() == 0


# ---- components --------------------------------------------------------------------------------------


def brute_groups(pairs):
    g = {v: v for v in itertools.chain(*pairs)}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(g[a], g[b])
            moved |= g[a] != m or g[b] != m
            g[a] = g[b] = m
    return g


@pytest.mark.parametrize("kind", ["random", "chain", "star", "tree"])
def test_components(spark, kind, monkeypatch):
    r = random.Random(1)
    pairs = {
        "random": [(r.randrange(80), r.randrange(80)) for _ in range(60)],
        "chain": [(k, k + 1) for k in r.sample(range(60), 55)],
        "star": [(50, k) for k in range(40)] + [(99, 50)],
        "tree": [(k, (k * 7 + 3) % 97) for k in range(97)],
    }[kind]
    pairs = [p for p in pairs if p[0] != p[1]]
    if kind == "star":
        monkeypatch.setattr(components, "_heavy", lambda df, key, rows: [(50,)])
    df = spark.createDataFrame([*pairs, *pairs[:5], (3, 3), (None, 2)], "u long, v long")
    assert {x.vertex: x.group for x in components.components(df).collect()} == brute_groups(pairs)


def test_components_empty(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_latest_links(spark):
    t = lambda d: datetime(2025, 1, d)
    rows = [(1, 1, 2, "match", t(1)), (2, 2, 1, " No_match", t(2)), (3, 3, 4, None, t(1)), (4, 4, 3, " MATCH", t(5)), (5, 5, 5, "match", t(1)), (6, 6, None, "match", t(1)), (7, 7, 8, "match", t(3)), (8, 7, 8, None, t(4)), (9, 1, 9, "match", None), (10, 9, 1, "unsure", t(1))]
    df = spark.createDataFrame(rows, "pair_id long, row_a long, row_b long, verdict string, decided_at timestamp")
    assert [tuple(r) for r in components.latest_links(df).collect()] == [(3, 4)]


# ---- packing -----------------------------------------------------------------------------------------------


def test_pack():
    r = np.random.default_rng(1)
    for cap in (1, 7, 100):
        sizes = r.integers(0, cap + 1, 2000)
        c = packing.pack(sizes, cap)
        room = np.bincount(c, sizes)
        assert room.max() <= cap and room.sum() == sizes.sum()
    assert len(packing.pack(np.zeros(0, np.int64), 5)) == 0
    sizes = r.integers(10, 60, 5000)
    assert sizes.sum() / ((packing.pack(sizes, 100).max() + 1) * 100) > 0.97


def test_pack_minimises_squares():
    """Each step is held against trying every level."""
    r = random.Random(2)
    cap, count = 12, Counter()
    sizes = [r.randint(1, 12) for _ in range(300)]
    room: dict[int, int] = {}
    for s, c in zip(sizes, packing.pack(np.array(sizes), cap).tolist()):
        was = room.get(c, 0)

        def cost(level):
            n = Counter(count)
            if level:
                n[level] -= 1
            if level + s < cap:
                n[level + s] += 1
            return sum(v * v for v in n.values())

        options = [0] + [h for h, v in count.items() if v > 0 and h + s <= cap]
        assert cost(was) == min(map(cost, options))
        if was:
            count[was] -= 1
        room[c] = was + s
        if room[c] < cap:
            count[room[c]] += 1


def test_containers(spark):
    rows = [(k, n) for k, n in enumerate([0, 5, 10, 11, 25, 3, 7, 9, 1, 30])] + [(None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece", F.lit("x"))
    sizes = spark.createDataFrame([("ten", 10), ("big", 1000), ("bad", None), ("zero", 0)], "size_name string, capacity_tokens int")
    for block in (20_000, 3):
        got = packing.containers(df, sizes, block=block).collect()
        assert {r.size_name for r in got} == {"ten", "big"}
        room = Counter()
        for r in got:
            room[r.size_name, r.container] += r.n_tokens
        assert all(v <= {"ten": 10, "big": 1000}[s] for (s, _), v in room.items())
        for k, n in rows[:10]:
            mine = sorted((r.first_token, r.n_tokens) for r in got if r.size_name == "ten" and r.doc_id == k)
            assert sum(m for _, m in mine) == n and len(mine) == max(1, -(-n // 10)) and [f for f, _ in mine] == [10 * i for i in range(len(mine))]
        assert sum(r.n_tokens for r in got if r.size_name == "big") == sum(n for _, n in rows)
    assert packing.containers(df.limit(0), sizes).count() == 0


def test_token_count(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a" * 100_000), (5, "天气")], "k int, t string")
    got = {r.k: r.n for r in df.select("k", tokens.token_count(F.col("t")).alias("n")).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: len(tokens.encoding().encode_ordinary("a" * 100_000)), 5: len(tokens.encoding().encode_ordinary("天气"))}


# ---- mixing ---------------------------------------------------------------------------------------------------


def test_mix(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "a", "a", "b", "c", None, "other"]), f"t{k if k % 10 else 0}", r.randint(0, 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text_id string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 5), ("gone", 0.1, 2), (None, 0.1, 1), ("x", None, 1), ("y", 0.1, 0)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, targets, slot=64)
    u = {x.doc_id: x for x in uses.collect()}
    assert len(u) == 3000
    most = {"a": 1, "b": 3, "c": 5}
    used = Counter()
    for k, s, t, n in rows:
        used[s, t] += u[k].uses
        assert u[k].uses <= most.get(s, 0)
    assert all(v <= most.get(s, 0) for (s, _), v in used.items())
    got = {x.source: x for x in shares.collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"].actual_share == 0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(got[s].actual_share - want) < 0.01, got[s]
        assert got[s].tokens_used == sum(x.n_tokens * x.uses for x in u.values() if x.source == s)


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text_id string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, targets)
    assert uses.count() == 0 and shares.first().actual_share == 0
    uses, shares = mixing.mix(df, targets.limit(0))
    assert uses.count() == 0 and shares.count() == 0


# ---- stuffing ------------------------------------------------------------------------------------------------------

PROSE = "The merge step keeps the last value of a record if the listing says so. A reader can ask for more than one page, and the answer is cut after that. We store each entry for two days before it moves to the archive. "
_KEY, _MORE = "weather forecast radar humidity pressure alert station rainfall".split(), "free best cheap buy top online trial price discount instant".split()


def _phrase(k: int) -> str:
    return f"{_MORE[k * 7 % 10]} {_KEY[k * 5 % 8]} {('api', 'data', 'list')[k % 3]}"


SPAM = {
    1: "free weather api buy weather data cheap weather api top weather free weather api best weather data trial weather api buy weather free weather",
    2: "\n".join(f"- [{_phrase(k)}](https://a{k}.example/x)" for k in range(20)),
    3: "\n".join(f"https://a{k}.example/x" for k in range(20)),
    4: "This news data is a news data made by news data fans for news data users. With news data you have news data and more news data. No news data is like this news data, so buy news data.",
    5: "天气查询 天气免费 天气接口 天气推荐 天气价格 天气查询 天气大全 天气免费 天气接口 天气推荐",
    6: " ".join(f"#{_phrase(k).title().replace(' ', '')}" for k in range(20)),
    # forms that only look like code, settings, change lists or status notes
    21: "\n".join(f"- `{_phrase(k)}`" for k in range(40)), 22: "\n".join(f"{_KEY[k % 8]}: {_phrase(k)}" for k in range(40)), 23: "\n".join(f"{_phrase(k)} => {_phrase(k + 3)}" for k in range(40)),
    24: "\n".join(f"1{k % 10}:2{k % 10} {_phrase(k)} {_phrase(k + 1)}" for k in range(40)), 25: "## 1.2.0\n" + "\n".join(f"- {_phrase(k)} {_phrase(k + 2)}" for k in range(40)), 26: "```\n" + "\n".join(f"{_phrase(k)} {_phrase(k + 2)}" for k in range(40)) + "\n```",
    27: "\n".join("Tags: " + ", ".join(_phrase(k + j) for j in range(6)) for k in range(10)), 28: "\n".join(f"{_KEY[k % 8]}: https://{_KEY[k % 8]}{k}.example/" for k in range(30)),
    # nothing new: abnormally low
    29: "The forecast of this station is a good one for you. " * 100, 30: PROSE * 400,
}
FINE = {
    11: PROSE, 12: PROSE + "\n\nTags: weather, wind, rain", 13: "def load(key):\n    rows = fetch(url, key)\n    return [r for r in rows]", 14: "GET /v1/rows?limit={n}\nPOST /v2/rows", 15: None, 16: "",
    17: "# Links\n- [A](https://a.example): The parser keeps the last heading it saw.\n- [B](https://b.example): A new key is sent by the team that asked for it.", 18: "如果数据缺失，我们会写成未知，而不是空字符串。搜索时先比较名称，再比较标签和分类，最后才看描述。",
    19: "# Changes\n\n## 2.1.0\n- Documented the 403 answer\n- Removed the old field",
    # prose of other languages, most of which the collection doesn't know
    31: "The committee met on Tuesday to discuss the new library. Several members asked whether the old building could be kept, since many people still use it. After a long talk they agreed to look at the costs again next month.",
    32: "図書館は駅から歩いて五分のところにあります。朝の九時に開いて、夜の八時に閉まります。本を借りるときは、カードを見せてください。雨の日は、子どもたちが絵本を読みに来ることが多いです。来月から新しい席が増えるので、もっとゆっくり過ごせるようになるでしょう。",
    33: "图书馆离车站很近，走路只要五分钟。每天早上九点开门，晚上八点关门。借书的时候请带上证件。下雨天有很多孩子来这里看书。下个月会增加新的座位，大家可以更舒服地阅读。",
    34: "Le comité s'est réuni mardi pour parler de la nouvelle bibliothèque. Plusieurs membres ont demandé si l'ancien bâtiment pouvait être gardé, car beaucoup de gens s'en servent encore.",
    35: "Комитет собрался во вторник, чтобы обсудить новую библиотеку. Некоторые участники спросили, можно ли сохранить старое здание, потому что им всё ещё пользуются многие люди.",
    36: "위원회는 화요일에 모여 새 도서관에 대해 이야기했습니다. 많은 사람들이 아직 옛 건물을 쓰고 있어서 그대로 둘 수 있는지 물었습니다. 긴 이야기 끝에 다음 달에 비용을 다시 살펴보기로 했습니다.",
    37: "ห้องสมุดอยู่ใกล้สถานีรถไฟ เดินเพียงห้านาทีก็ถึง เปิดเก้าโมงเช้าและปิดสองทุ่ม เวลายืมหนังสือโปรดแสดงบัตร",
    38: "اجتمعت اللجنة يوم الثلاثاء لمناقشة المكتبة الجديدة. سأل بعض الأعضاء هل يمكن الاحتفاظ بالمبنى القديم لأن كثيرا من الناس ما زالوا يستخدمونه.",
}


@pytest.fixture(scope="module")
def crawl(spark, tiny):
    """The test pages, planted each twice among a thousand others, beside a column with a clashing name."""
    base = spark.read.parquet(tiny.replace("sf0.001", "sf0.01") + "/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang")
    rows = [(k, t, None) for k, t in (SPAM | FINE).items()] + [(k + 500, t, "xx") for k, t in (SPAM | FINE).items()]
    return base.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumn("share", F.lit("x"))


def test_stuffed_pages(spark, crawl):
    got = [r.doc_id for r in stuffing.stuffed_pages(crawl).where("doc_id < 1000").collect()]
    assert sorted(got) == sorted([*SPAM, *[k + 500 for k in SPAM]])


def test_page_scores(spark, crawl):
    got = stuffing.page_scores(crawl.drop("lang")).where("doc_id < 1000")
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 2 * len(SPAM | FINE)
    assert by[15].flag is False and by[15].share == 0 and by[15].perplexity == 1 and by[16] == by[516].__class__(**(by[516].asDict() | {"doc_id": 16}))
    assert by[29].repeated < 1.3 < by[29].perplexity
    assert stuffing.stuffed_pages(crawl.limit(0)).count() == 0 and stuffing.page_scores(crawl.limit(0)).count() == 0


def test_common_words_are_learned(spark, crawl):
    found = stuffing.vocabulary(crawl.where("text is not null").select("lang", "text").replace("EN", "en", "lang"))
    own = found.languages
    assert all("en" in own[w] for w in ("the", "of", "is", "to", "for")) and all("de" in own[w] for w in ("und", "der", "die")) and "zh" in own["的"]
    assert not any("en" in own.get(w, ()) for w in ("discount", "humidity", "coupon"))


def test_portions_do_not_matter(monkeypatch):
    vocab = stuffing.Vocabulary({"en": {w: (0.5, 0.03) for w in "the a of is for".split()}}, frozenset("cat dog list name".split()))
    texts = ["the cat is a dog.\nlist: name", "", "cat " * 50, "a\n" * 9, "name = list"]
    sequences = [stuffing.classes(t, vocab)[0] for t in texts]
    model = stuffing.Model(np.ones(stuffing._SIZE**3), np.ones(stuffing._SIZE**3))
    whole = [x.tolist() for x in model.judge(sequences, np.ones(len(texts)))]
    monkeypatch.setattr(stuffing, "AT_ONCE", 3)
    assert sum(map(len, stuffing._portions(sequences))) == 4 and len(list(stuffing._portions(sequences))) > 2
    assert [x.tolist() for x in model.judge(sequences, np.ones(len(texts)))] == whole


def test_tokens_in_linear_time():
    """Long runs of one character are cut at once; a process of its own, so a slow pattern can be ended."""
    import subprocess
    import sys

    code = "from tessera.llm.stuffing import classes, Vocabulary as V; print([len(classes(s, V({}, frozenset()))[0]) > 0 for s in ('-' * 5000 + ' x', '<a ' * 3000, \"a'\" * 5000, '[' * 9000, 'word, ' * 9000, 'http://' * 3000, 'x' * 90000)])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=30, check=True, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(stuffing.__file__)) + "/.."})
    assert done.stdout.strip() == str([True] * 7)
