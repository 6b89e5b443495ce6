"""The text and algorithm operators: literal cases, brute force, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.llm import components, nearcopies, packing, pairs, pieces, quantiles, residue, sentences, tokens

LONG = "word " * 60_000


def docs(spark, rows):
    """Texts with extra columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, _id string, n double")


# -- sentences ------------------------------------------------------------------------------------

CASES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Dr. Smith saw 3.14 at 6.13 a.m. and left. pH stood at 8.2.", ["Dr. Smith saw 3.14 at 6.13 a.m. and left.", "pH stood at 8.2."]),
    ("It came at 7.12 p.m. As in 2003, it left.", ["It came at 7.12 p.m.", "As in 2003, it left."]),
    ("“Nobody did. Not us,” said A. “Is it safe?” asked B.", ["“Nobody did. Not us,” said A.", "“Is it safe?” asked B."]),
    ("他说：“没想到。谁也没想到。”第二句！第三句？", ["他说：“没想到。谁也没想到。”", "第二句！", "第三句？"]),
    ("担当者は「まさか。誰も。」と述べた。次の文。", ["担当者は「まさか。誰も。」と述べた。", "次の文。"]),
    ('관계자는 "몰랐다. 아무도."고 말했다. 조사는 2017.5. 643번 정점에서 시작됐다. 0.1... 그러다 올랐다.', ['관계자는 "몰랐다. 아무도."고 말했다.', "조사는 2017.5. 643번 정점에서 시작됐다.", "0.1... 그러다 올랐다."]),
    ("„Nein. Nie“, sagte er. Am 11. Dezember sank z. B. der Wert (vgl. Abb. 18). Ende.", ["„Nein. Nie“, sagte er.", "Am 11. Dezember sank z. B. der Wert (vgl. Abb. 18).", "Ende."]),
    ("उसने कहा, “नहीं थी। किसी को नहीं।”\nडॉ. Ram आए। सं. 8 है।", ["उसने कहा, “नहीं थी। किसी को नहीं।”", "डॉ. Ram आए।", "सं. 8 है।"]),
    ("ประโยคแรก ประโยคสอง มี 3 ตัว จบ", ["ประโยคแรก", "ประโยคสอง", "มี 3 ตัว", "จบ"]),
    ("A heading here\n\n1. An item\n \n- other item\n\nBody wraps\nover lines. End.", ["A heading here", "1. An item", "- other item", "Body wraps\nover lines.", "End."]),
    ("fell in 2002.According to him it rose.본다.특히 그렇다.", ["fell in 2002.", "According to him it rose.", "본다.", "특히 그렇다."]),
    ("See https://a.example/x.y?q=1. The list v1.2 in a.v27.csv ends.", ["See https://a.example/x.y?q=1.", "The list v1.2 in a.v27.csv ends."]),
    ("Who knew?! It rose ... then fell. ", ["Who knew?!", "It rose ... then fell."]),
]


def test_sentences(spark):
    df = docs(spark, list(enumerate(t for t, _ in CASES)))
    got = {}
    for r in sentences.sentence_texts(df, "doc_id", "text").orderBy("doc_id", "sentence_no").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
        assert CASES[r["doc_id"]][0][r["start_char"] : r["end_char"]] == r["sentence"]
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want


def test_long_quotations_and_urls(spark):
    inner = "Nobody did. It was so! Was it? " * 60
    texts = []
    for a, b in (("“", "”"), ("«", "»"), ("„", "“"), ('"', '"')):
        texts.append(f"{a}{inner.strip()}{b}, said the man. It rained.")
    texts += [f"他说：“{'没有。真的！' * 300}”第二句。", f"担当者は「{'まさか。' * 400}」と述べた。次の文。", "See https://a.example/" + "x.y/" * 200 + "end. It rained."]
    got = {r["doc_id"]: r["n"] for r in sentences.sentence_units(docs(spark, list(enumerate(texts))), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == dict.fromkeys(range(len(texts)), 2)


def test_sentence_edges(spark):
    df = docs(spark, [(1, None), (2, ""), (3, " \n\n\t "), (4, LONG + ". 😀 End."), (5, "Twice."), (5, "Twice.")])
    got = sorted(map(tuple, sentences.sentence_units(df, "doc_id", "text").collect()))
    assert got == [(4, 0, len(LONG) + 1), (4, len(LONG) + 2, len(LONG) + 8), (5, 0, 6), (5, 0, 6)]
    assert sentences.sentence_units(df.limit(0), "doc_id", "text").collect() == []


# -- pieces ---------------------------------------------------------------------------------------


def test_pieces_obey_the_rules():
    r = np.random.default_rng(0)
    for k in range(200):
        words = ["".join(r.choice(list("abc。."), r.integers(1, 40 if k % 3 else 150))) for _ in range(60)]
        t = "".join(w + r.choice([" ", "\n", "\n\n", ""]) for w in words)
        got = pieces.split_text(t, 100, 20, slab=400)
        assert got[0][0] == 0 and got[-1][1] == len(t)
        for a, b, _ in got:
            assert 0 < b - a <= 100
        for (_, b, _), (c, d, _) in zip(got, got[1:]):
            assert b - 20 <= c <= b < d
        strength = pieces.cut_strengths(t)
        assert all(bool(strength[b]) != f for _, b, f in got)
        longest = pieces.longest_stretch(t)
        if longest <= 99:
            assert not any(f for _, _, f in got)
        if longest > 100:
            assert any(f for _, _, f in got)


def test_range_maximum_prefers_the_right():
    r = np.random.default_rng(1)
    s = r.integers(0, 4, 300)
    table = pieces.SparseMax(s)
    for _ in range(500):
        a, b = sorted(r.integers(0, 300, 2).tolist())
        best = max(range(a, b + 1), key=lambda i: (s[i], i))
        assert table.best(a, b) == (s[best], best)


def test_piece_edges(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "x" * 1000), (4, "y" * 2500), (5, LONG), (5, LONG)])
    got = {r["doc_id"]: r["pieces"] for r in pieces.split_oversized(df, "doc_id", "text").collect()}
    assert got[1] is None and len(got[2]) == 1 and len(got[3]) == 1 and any(p["forced"] for p in got[4]) and not any(p["forced"] for p in got[5])
    assert pieces.split_oversized(df.limit(0), "doc_id", "text").collect() == []
    assert pieces.piece_texts(df, "doc_id", "text").where("doc_id = 3").count() == 1
    with pytest.raises(ValueError):
        pieces.split_text("a b", 10, 10)


# -- quantiles ------------------------------------------------------------------------------------


def rank_error(x, q, v):
    x = np.sort(x)
    return max(0.0, np.searchsorted(x, v, "left") / len(x) - q, q - np.searchsorted(x, v, "right") / len(x))


def test_sketch_error_merge_and_deletion():
    r = np.random.default_rng(0)
    x = np.concatenate([r.lognormal(0, 3, 40_000), -r.lognormal(0, 2, 20_000), np.zeros(15_000), np.full(5_000, -999.0), [np.inf, -np.inf]])
    whole = quantiles.Sketch().add(x)
    halves = quantiles.Sketch().add(x[::2]).merge(quantiles.Sketch().add(x[1::2]))
    for q in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99):
        assert rank_error(x, q, whole.quantile(q)) < 0.005
        assert whole.quantile(q) == halves.quantile(q)
    extra = r.normal(50, 1, 30_000)
    back = quantiles.Sketch().add(x).add(extra).add(extra, -np.ones(len(extra)))
    assert back.to_bytes() == whole.to_bytes()
    assert back.total == whole.total and all((back.tables[j] == whole.tables[j]).all() for j in back.tables)
    again = quantiles.Sketch.from_bytes(whole.to_bytes(), whole.total)
    assert all((again.tables[j] == whole.tables[j]).all() for j in again.tables)


def test_key_order():
    x = np.array([-np.inf, -1e300, -5.0, -1e-60, -0.0, 0.0, 1e-60, 2.5, 2.5 + 2**-50, 4e38, 1e300, np.inf])
    k = quantiles.encode_values(x)
    assert (k[1:] >= k[:-1]).all() and k[4] == k[5] and len(set(k.tolist())) == len(x) - 1
    assert (quantiles.decode_keys(k) == x).all()


def test_merging_holds_one_group_at_a_time():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(4)
    one = quantiles.Sketch().add(r.normal(0, 1, 3000))
    assert one.tables is not None or not one._settle()
    data = one.to_bytes()
    dense = sum(t.nbytes for t in one.tables.values())
    rows = 600

    def batches():
        for k in range(0, rows, 20):
            yield pa.RecordBatch.from_arrays([pa.array([x // 2 for x in range(k, k + 20)]), pa.array([3000] * 20), pa.array([data] * 20, pa.binary())], names=["g", "n", "sketch"])

    tracemalloc.start()
    n = 0
    for b in quantiles.merge_runs(batches(), ["g"]):
        assert b.column("n").to_pylist() == [6000] * b.num_rows
        n += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and peak < 300 * dense / 4


def test_group_quantiles(spark):
    rows = [("a", float(i)) for i in range(1000)] + [(None, 1.0), (None, 1.0), ("b", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = quantiles.sketch_quantiles(quantiles.merge_sketches(quantiles.build_sketches(df, ["g"], "v"), ["g"]), ["g"], [0.0, 0.5, 1.0]).collect()
    by = {(r["g"], r["q"]): (r["n"], r["value"]) for r in got}
    assert set(g for g, _ in by) == {"a", None} and by[(None, 0.5)] == (2, 1.0)
    assert by[("a", 0.0)][1] == 0.0 and abs(by[("a", 1.0)][1] - 999.0) < 6 and abs(by[("a", 0.5)][1] - 499.5) < 6
    # large groups, from parts of both forms, with deletions
    r = np.random.default_rng(2)
    big = spark.createDataFrame([("L", float(x), 1) for x in r.normal(0, 100, 30_000)] + [("L", 7.0, s) for s in (1, -1)] + [("S", 7.0, 1), ("S", 8.0, 1), ("S", 8.0, -1)], "g string, v double, w int").repartition(7)
    merged = quantiles.merge_sketches(quantiles.build_sketches(big, ["g"], "v", "w"), ["g"])
    got = {(x["g"], x["q"]): (x["n"], x["value"]) for x in quantiles.sketch_quantiles(merged, ["g"], [0.25, 0.5]).collect()}
    assert got[("S", 0.5)] == (1, 7.0) and got[("L", 0.5)][0] == 30_000 and abs(got[("L", 0.5)][1]) < 3 and abs(got[("L", 0.25)][1] + 67.4) < 3
    assert quantiles.merge_sketches(quantiles.build_sketches(df.limit(0), ["g"], "v"), ["g"]).collect() == []


# -- pairs ----------------------------------------------------------------------------------------


UNSEEN_REFUSALS = [
    "I won't make a quiz question out of this.", "Apologies, but I can't produce anything from such a text.", "We do not have enough context for a question.", "It is not possible that questions be generated from one line.",
    "No me es posible elaborar preguntas con un texto tan corto.", "El documento no contiene datos para una sola pregunta.", "Hierzu lassen sich keine Fragen bilden.", "Ich kann diese Bitte leider nicht bearbeiten.",
    "본문이 짧아 문제를 출제해 만들 수 없네요.", "그 요청은 제가 처리할 수 없습니다.", "このテキストから問題を生成できません。", "この質問には対応できない状態です。", "我没法根据这篇文章编写任何提问。", "资料不够，写不出问题。", "ไม่สามารถสร้างคำถามได้", "इस लेख से सवाल नहीं बना सकते",
]
STATEMENTS = ["The crew could not reach the bay.", "Fishers cannot enter the harbour.", "No nets were lost.", "Die Crew kann den Hafen nicht erreichen.", "El barco no puede salir del puerto.", "어민들은 항구에 들어갈 수 없다.", "船不能进入港口。"]


def test_refusals_that_were_not_seen():
    found = [pairs.is_refusal(t) for t in UNSEEN_REFUSALS]
    assert sum(found) >= 0.85 * len(found), [t for t, f in zip(UNSEEN_REFUSALS, found) if not f]
    assert [t for t in STATEMENTS if pairs.is_refusal(t)] == []
    assert not pairs.is_refusal("Why did the crew say that it cannot make a request?")


def labelled(spark):
    """Texts of four languages, as many as a small test needs."""
    lines = {
        "en": "The boat left the harbour in the morning and towed a net behind it. What did the crew find in the samples that were taken near the bay? How fast do the fibres sink, and who counted them at which time?",
        "ko": "배는 아침에 항구를 떠나 그물을 끌었다. 선원들은 만 근처에서 채취한 시료에서 무엇을 찾았나요? 자료집에는 몇 개의 정점이 실려 있나요?",
        "es": "El barco salió del puerto por la mañana y arrastró una red. ¿Qué encontró la tripulación en las muestras que se tomaron cerca de la bahía? ¿Cómo se contaron y quién las tomó?",
        "zh": "船在早上离开港口，拖着一张网。船员在海湾附近采集的样品中发现了什么？谁在什么时候数了它们？",
    }
    return spark.createDataFrame([(k, v) for k, v in lines.items()] * 3 + [(None, "x"), ("en", None), ("en", " ")], "lang string, text string")


def test_broken_pairs(spark):
    doc = "The boat left Alva Bay at 6.13 a.m. and towed a net. Mussels at Orn Point carried fibres."
    good = [f"How fast do {w} fibres sink?" for w in ("nylon", "acrylic", "rope", "laundry")] + ["At what time did the boat leave Alva Bay?"]
    rows = [
        (1, doc, good), (1, doc, good), (2, doc, None), (3, doc, []),
        (4, doc, [None, "", " - ", "3. ", "Q:", "​"]),
        (5, doc, ["I'm sorry, but I can't write questions about Alva Bay from this passage.", "2. 죄송합니다. 미솔항에 관한 질문은 만들 수 없습니다.", "Why did the crew say it could not help?"]),
        (6, doc, ["- MUSSELS  AT ORN POINT CARRIED FIBRES?", doc, "Mussels at Orn Point"]),
        (7, doc, ["자료집에 실린 정점은 몇 개인가요?", "¿Cómo se tomaron las muestras 810 y 16?"]),
        (8, doc, ["At what time did the boat lea", "At what time did the boat leave Alva", "At what time did the boat leave Alva Bay", "How fast do nylon..."]),
        (9, None, ["What is it?", None]), (10, LONG, ["At what time did the boat leave Alva Bay?"]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "state_id long, document string, queries array<string>, defect string")
    got = {}
    for r in pairs.broken_pairs(df, labelled(spark)).collect():
        got.setdefault(r["state_id"], {})[r["query_pos"]] = r["defect"]
    assert got.get(1) is None and got[2] == got[3] == {-1: "empty"}
    assert got[4] == dict.fromkeys(range(6), "empty")
    assert {k: v for k, v in got[5].items() if k < 2} == {0: "refusal", 1: "refusal"} and got[5].get(2) != "refusal"
    assert got[6] == {0: "copy", 1: "copy", 2: "truncated"}
    assert got[7] == {0: "other_language", 1: "other_language"}
    assert got[8] == {0: "truncated", 1: "truncated", 3: "truncated"}
    assert got[9] == {1: "empty"} and 10 not in got
    assert pairs.broken_pairs(df.limit(0), labelled(spark)).collect() == []
    # without a label no language is another one
    assert {r["defect"] for r in pairs.broken_pairs(df, labelled(spark).limit(0)).collect()} == {"empty", "refusal", "copy", "truncated"}


def test_copies_are_aligned():
    doc = "Mussels at Orn Point carried fibres. The boat left Alva Bay at 6.13 a.m. and towed a net.\n\nIt rained."
    tight = "\x00".join(pairs.squash(p) for p in doc.split("\n\n"))
    own = lambda t: pairs.squash(pairs.END_MARK.sub("", t))
    copies = ["Mussels at Orn Point carried fibres", "THE BOAT left Alva Bay at 6.13 a.m. and towed a net!", "It rained", doc, "Mussels at Orn Point carried fibers"]
    others = ["Mussels at Orn Point", "The boat left Alva Bay", "carried fibres", "It snowed", "Did mussels at Orn Point carry fibres?"]
    texts = [own(t) for t in copies[:4] + others]
    share = pairs.contained(texts, ["", tight], np.ones(len(texts), np.int64))
    for t, x in zip(texts, share):
        grams = [t[k : k + 5] for k in range(max(1, len(t) - 4))]
        assert x == pytest.approx(sum(g in tight for g in grams) / len(grams))
    assert [t for t in copies if not pairs.is_aligned_copy(own(t), tight)] == []
    assert [t for t in others if pairs.is_aligned_copy(own(t), tight)] == []
    # copies of a few letters count too
    assert pairs.contained(["네", "아니"], ["네.\x00예."], np.zeros(2, np.int64)).tolist() == [1.0, 0.0]


def test_longest_common_subsequence():
    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = (list(r.choice(list("abcd"), r.integers(0, 15))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.lcs_length(a, b) == t[-1][-1]


# -- near-duplicates ------------------------------------------------------------------------------


def test_components(spark):
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {x["id"]: x["component"] for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def articles(n=60, copies=90):
    r = np.random.default_rng(7)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(3, 9))) for _ in range(3000)]
    boiler = " ".join(r.choice(words, 40))

    def edit(t):
        w = t.split()
        for i in r.choice(len(w), max(1, len(w) // 25), replace=False):
            w[i] = str(r.choice(words))
        return " ".join(w)

    rows = []
    for k in range(n):
        t = boiler + " " + " ".join(r.choice(words, r.integers(20, 300)))
        rows.append(("t", t))
        if k % 3 == 0:
            rows.append((None, edit(t)))
        if k % 5 == 0:
            rows.append(("T!", t.upper() + " ..."))
    crowd = " ".join(r.choice(words, 120))
    rows += [("c", edit(crowd)) for _ in range(copies)]  # a crowd of copies of one text
    rows += [(None, None), ("x", ""), ("x", "  "), (None, "ab"), (None, "ab"), ("", "一二三四五六七八九十"), (None, "一二三四五六七八九十"), (None, LONG), (None, LONG + "tail")]
    return [(i + 1, a, b) for i, (a, b) in enumerate(rows)]


@pytest.mark.parametrize("parts", [1, 6])
def test_near_copies_against_brute_force(spark, parts):
    rows = articles()
    df = spark.createDataFrame([(*x, "z") for x in rows], "seq_num long, title string, content string, id string").repartition(parts)
    groups = nearcopies.near_copies(df, "seq_num", "title", "content")
    got = set(map(tuple, nearcopies.group_pairs(groups, "seq_num", "group_id", "a", "b").collect()))
    keys = {}
    for i, t, c in rows:
        if c and c.strip():
            s = "".join(x for x in ((t or "") + c).lower() if x.isalnum())
            keys[i] = (s, {s[k : k + 5] for k in range(len(s) - 4)} or {s})
    parent = {i: i for i in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(keys)
    for x in ids:
        for y in ids:
            if x < y and len(keys[x][1] & keys[y][1]) >= 0.6 * len(keys[x][1] | keys[y][1]):
                parent[find(y)] = find(x)
    want = {(x, y) for x in ids for y in ids if x < y and find(x) == find(y)}
    assert got == want and len(want) > 90 * 89 / 2
    assert nearcopies.near_copies(df.limit(0), "seq_num", "title", "content").collect() == []


@pytest.mark.parametrize("parts", [1, 6])
def test_crowd_around_a_late_centre(spark, parts):
    r = np.random.default_rng(5)
    base = r.choice(list("abcdefghijklmnopqrstuvwxyz"), 900)
    texts = []
    for _ in range(150):
        # copies are alike to the base in the middle, and hardly to each other
        x = base.copy()
        for at in r.choice(900, 40, replace=False):
            x[at] = r.choice(list("0123456789"))
        texts.append("".join(x))
    texts.append("".join(base))
    grams = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    alike = lambda x, y: len(grams[x] & grams[y]) >= 0.6 * len(grams[x] | grams[y])
    with_base = [x for x in range(150) if alike(x, 150)]
    assert len(with_base) > 100 and sum(alike(x, y) for x in range(150) for y in range(x)) < 150
    parent = list(range(151))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for y in range(151):
        for x in range(y):
            if alike(x, y):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    df = spark.createDataFrame([(i + 1, None, t) for i, t in enumerate(texts)], "seq_num long, title string, content string").repartition(parts)
    got = {x["seq_num"] - 1: x["group_id"] - 1 for x in nearcopies.near_copies(df, "seq_num", "title", "content").collect()}
    assert got == {x: find(x) for x in range(151) if sum(find(y) == find(x) for y in range(151)) > 1}


def pairs_found(spark, texts, parts=4):
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "seq_num long, title string, content string").repartition(parts)
    sketched = df.select("seq_num", "title", "content").mapInArrow(nearcopies._sketch(0.6), nearcopies.SKETCHED_DDL)
    return set(map(tuple, nearcopies.candidate_pairs(sketched, 0.6).collect()))


def alike(a, b):
    x, y = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_with_edits_spread_evenly_or_at_random(spark):
    r = np.random.default_rng(21)
    letters, other = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    texts, want = [], set()
    for k in range(700):
        # every length from a line to a long article, edits of three kinds
        base = r.choice(letters, int(r.choice([24, 40, 80, 200, 400, 900, 3000])))
        if k % 2:
            edits = set(range(int(r.integers(0, 20)), len(base), 20 + k % 7))
        else:
            edits = set(np.flatnonzero(r.uniform(size=len(base)) < r.uniform(0.03, 0.06)).tolist())
        out = []
        for i, c in enumerate(base):
            kind = k % 3 if k % 5 else int(r.integers(0, 3))
            out += [c] if i not in edits else [str(r.choice(other))] if kind == 0 else [c, str(r.choice(other))] if kind == 1 else []
        texts += ["".join(base), "".join(out)]
        if alike(*texts[-2:]) >= 0.6:
            want.add((2 * k, 2 * k + 1))
    close = sum(alike(texts[a], texts[b]) < 0.65 for a, b in want)
    assert len(want) > 400 and close > 100
    got = [pairs_found(spark, texts, n) for n in (1, 6, 64)]
    assert got[0] == got[1] == got[2] and want <= got[0]


def test_groups_of_bounded_bytes_find_the_same_pairs(spark, monkeypatch):
    texts = [x for _, t, c in articles(30, 20) if c for x in [(t or "") + c]]
    whole = pairs_found(spark, texts)
    held = []
    packed = nearcopies._packed
    monkeypatch.setattr(nearcopies, "_packed", lambda table: held.append(table.select(["cols", "bits"]).nbytes) or packed(table))
    monkeypatch.setattr(nearcopies, "HELD_BYTES", 9_000)
    assert pairs_found(spark, texts) == whole and len(whole) > 200
    # no task holds all documents
    assert len(held) > 4 and max(held) < sum(held) / 2


# -- tokens ---------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "Hello  world's 123abc\n\n", "가나다 漢字 ไทย हिन्दी 😀<|endoftext|>", LONG, "a" * 30_000, ("x1" * 9000) + " \n\t " * 50, "é" * 9000 + " it's  "]


def test_encoding_round_trip(spark):
    if not __import__("os").path.exists(tokens.default_path()):
        pytest.skip("no rank files here")
    df = docs(spark, list(enumerate(TEXTS)))
    out = tokens.encode_ids(df)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    enc = tokens.encoding(tokens.default_path())
    for i, t in enumerate(TEXTS):
        assert got[i] == (enc.encode_ordinary(t) if t else [])
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_ids(df.limit(0)).collect() == []


def test_safe_pieces_do_not_change_ids():
    if not __import__("os").path.exists(tokens.default_path()):
        pytest.skip("no rank files here")
    enc = tokens.encoding(tokens.default_path())
    for t in filter(None, TEXTS):
        for size in (1, 7, 64):
            cut = tokens.safe_pieces(t[:3000], size)
            assert "".join(cut) == t[:3000] and sum((enc.encode_ordinary(p) for p in cut), []) == enc.encode_ordinary(t[:3000])


# -- packing --------------------------------------------------------------------------------------


def test_best_fit_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(60):
        sizes = r.integers(1, 41, r.integers(0, 90))
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(x, -k) for k, x in enumerate(room) if x >= sizes[i]]
            k = -min(fit)[1] if fit else len(room)
            if k == len(room):
                room.append(40)
            room[k] -= sizes[i]
            want[i] = k
        got = packing.best_fit_decreasing(sizes, 40)
        assert len(set(got)) == len(room) and np.bincount(got, weights=sizes, minlength=1).max(initial=0) <= 40
        assert sorted(np.bincount(got, weights=sizes)) == sorted(40 - x for x in room) if len(sizes) else True


def test_packing(spark):
    if not __import__("os").path.exists(tokens.default_path()):
        pytest.skip("no rank files here")
    df = docs(spark, [(1, None), (2, ""), (3, LONG), (4, "one"), (4, "one")] + [(10 + i, "word " * (i % 37 + 1)) for i in range(300)]).repartition(3)
    rows = packing.pack_documents(df, capacity=64).collect()
    load, sizes = {}, {}
    for r in rows:
        sizes.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    want = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert max(load.values()) <= 64 and sum(load.values()) / (64 * len(load)) > 0.97
    assert sizes[1] == sizes[2] == [(0, 0, 0)] and len(sizes[4]) == 2
    assert sum(n for _, _, n in sizes[3]) == want[3] and [s for _, s, _ in sorted(sizes[3])] == list(range(0, want[3], 64))
    assert packing.pack_documents(df.limit(0)).collect() == []


# -- residue --------------------------------------------------------------------------------------

SLOT_TEXTS = [
    "The net was towed at {{ sampling_date }} a.m.", "조사는 {station_name}. 시작됐다.", "Bei <%= unit %> sank es.", "Al #{title} de la isla.", "%(author)s年3月", "[[method]] from here.", "値は__UNIT__です", "比%OBS.COUNT%多", "At @@DATE@@ it rose.", "Held by <method> crews.", "fell to &lt;name&gt; below",
    "[INSERT TITLE] follows.", "[author 입력] 조사", "{% 지점 %} 해역", "The mean at undefined was NaN pieces on Invalid Date.", "Dear [object Object], hello.", "null에서 채집한 시료 null점을", "TODO: add the paragraph on it.", "(여기에 본문 삽입)", "XX pieces were counted at XXXX on DD/MM/YYYY.", "Your article body here.", "ダミーの文章です。",
]
FINE_TEXTS = [
    "Files follow the pattern {station}_{date}, as the handbook says.", "The set {PE, PP, PS} covers most.", 'Kept as JSON, e.g. {"site": "A", "n": 9}.', "The mean is $\\bar{x}_{21}$ here.", "The mesh <16 µm> was torn [sic].", "The term NaN marks a lost filter.", "A null result at the bay means little.", "Readers without JavaScript can call us.",
    "An early draft still held lorem ipsum text, a clerk said.", "예시에는 [기관명], [채집일] 칸이 있다.", "누리집은 '페이지를 찾을 수 없습니다'라는 안내만 띄웠다.", "점검 중 발견된 실은 치워졌다.", "Access to the reef was denied to the vessel.", "由10.4%降到28.35%，又由5%升到6%。", "A <b>bold</b> claim rose 10% in 2% steps.",
]
PAGE_TEXTS = [
    "Please turn on JavaScript to read this article.", "Home | Surveys | About\n404 Not Found.", "A title of some report\nBad gateway (502). The upstream host did not answer in time.\n© Wire 2001", "요청하신 페이지를 찾을 수 없습니다. 주소를 확인해 주세요. (코드 403)", "お探しのページは見つかりませんでした（502）。",
    "Lorem ipsum dolor sit amet. Magna anim nostrud elit.", "test test test asdf qwer test", "SEITE NICHT GEFUNDEN – FEHLER 410.", "您访问的页面不存在或已被删除。错误代码：404",
]


def test_residue_wording(spark):
    assert [t for t in SLOT_TEXTS if not residue.left_in(t)] == []
    assert [t for t in FINE_TEXTS if residue.left_in(t)] == []
    seeds = PAGE_TEXTS[:1] + PAGE_TEXTS[2:4] + PAGE_TEXTS[5:]
    assert [t for t in seeds if not any(residue.is_seed(p) for p, _, _ in residue.parts_of(t))] == []
    article = "The boat left the bay and towed a net. " * 3
    texts = FINE_TEXTS + [article + PAGE_TEXTS[0], "A title only", LONG, PAGE_TEXTS[0], PAGE_TEXTS[5], PAGE_TEXTS[7], article + "\n" + PAGE_TEXTS[7]]
    n = len(FINE_TEXTS) + 3
    assert sorted(r[0] for r in residue.residue(docs(spark, list(enumerate(texts)))).collect()) == [n, n + 1, n + 2]
    assert residue.left_in(LONG + SLOT_TEXTS[0])


def test_parts_of_a_page():
    cut = lambda t: [x for x, _, _ in residue.parts_of(t)]
    assert cut("404 Not Found. The page on Alva Bay is away.\nHome | About") == ["404 Not Found.", "The page on Alva Bay is away.", "Home | About"]
    assert cut("页面不存在。错误代码：410 The store failed; retry in 9 seconds.") == ["页面不存在。", "错误代码：410", "The store failed; retry in 9 seconds."]
    assert cut("Zur Startseite 您的页面。") == ["Zur Startseite", "您的页面。"] and cut("(코드 403) No such page.") == ["(코드 403)", "No such page."]
    assert residue.message_text("The page on Alva Bay took 12 s") == residue.message_text("The page on 갈온만 took 7 s") == "the page on ¤ took 0 s"


def test_long_slots():
    long = "sampling station name " * 6
    name = "stationname" * 6
    slots = ["{{ name | default(" + long + ") | upper }}", "{% for x in " + long + "%}", "<%= " + long + "%>", "[[" + long + "]]", "@@" + name + "@@", "%" + name + "%", "<" + name + ">", "&lt;" + name + "&gt;", "[insert " + long + "]", "[" + long + "입력]", "(여기에 " + long + " 삽입)", "（在此" + long + "填写）", "Blindtext " + long + "bitte ersetzen"]
    assert [x for x in slots if not residue.left_in("Here is " + x + " at last.")] == []


def test_residue_spreads_through_messages(spark):
    known, unknown = "Bad gateway (502).", "Our store of articles is closed for the night and will open again in the early morning."
    variant = "Our store of articles is closed for the night and will open again in the late morning."
    plain = "The boat left Alva Bay and towed a net. " * 20
    rows = [
        (1, f"{known} {unknown}"), (2, unknown), (3, f"A title\n{variant}\nHome | About"), (4, plain), (5, SLOT_TEXTS[0] + plain), (6, (SLOT_TEXTS[0] + plain).replace("{{ sampling_date }}", "nine")),
        (7, unknown), (8, None), (9, ""), (10, "  "), (11, LONG), (12, f"{unknown} {plain}"), (13, "Our store sells articles of every kind."), (14, f"{unknown} 404 Not Found."),
    ]
    got = sorted(r[0] for r in residue.residue(docs(spark, rows)).collect())
    # 2 and 7 by the message beside a seed in 1, 3 as a near-duplicate of it, 5 by its slot
    assert got == [1, 2, 3, 5, 7, 14]
    # a sentence that stands in as many other texts takes no label
    common = [(1, f"{known} {unknown}"), (2, f"{unknown} {plain}"), (3, f"{unknown} More of it. {plain}")]
    assert [r[0] for r in residue.residue(docs(spark, common)).collect()] == []
    assert residue.residue(docs(spark, rows).limit(0)).collect() == []


def test_plans_do_not_double_with_the_rounds(spark, monkeypatch):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefghijklmnop"), 7))
    chain = [[word() for _ in range(24)]]
    for k in range(6):
        chain.append([word() if i == 3 * k + 2 else w for i, w in enumerate(chain[-1])])
    rows = [(0, f"Bad gateway (502). {' '.join(chain[0])}.")] + [(k, f"{' '.join(x)}.") for k, x in enumerate(chain) if k]
    scans, linked = [], residue.linked_kinds
    monkeypatch.setattr(residue, "linked_kinds", lambda f, kinds, t: scans.append(kinds._jdf.queryExecution().logical().toString().count("parquet")) or linked(f, kinds, t))
    assert sorted(x[0] for x in residue.residue(docs(spark, rows)).collect()) == list(range(7))
    assert len(scans) > 5 and max(scans) < 8 * len(scans)


def test_linked_messages_against_brute_force(spark):
    r = np.random.default_rng(11)
    words = ["".join(r.choice(list("abcdefghijklmnop"), r.integers(3, 9))) for _ in range(600)]
    seeds, others = [], []
    for _ in range(60):
        m = [str(w) for w in r.choice(words, int(r.integers(8, 40)))]
        seeds.append(" ".join(m))
        for k in range(1, 6):
            x = list(m)
            for i in r.choice(len(x), min(k, len(x) // 5), replace=False):
                x[i] = str(r.choice(words))
            others.append(" ".join(x))
    others = [m for m in dict.fromkeys(others) if m not in seeds]

    def frame(texts, first):
        return spark.createDataFrame([(first + i, *map(int, p), t) for i, (t, p) in enumerate(zip(texts, residue.simhashes(texts).view(np.int64)))], "kind long, s1 long, s2 long, message string")

    got = {x[0] for x in residue.linked_kinds(frame(seeds, 10_000), frame(others, 0), 0.8).collect()}
    sets = [residue.shingles(t) for t in seeds]
    want = {i for i, t in enumerate(others) if max(nearcopies.jaccard(residue.shingles(t), x) for x in sets) >= 0.8}
    assert got <= want and len(want) > 60 and len(got) >= 0.95 * len(want)


def test_simhash_counts_bits():
    texts = ["", "ab", "the quick brown fox jumps over", "가나다라마바사" * 50, LONG]
    got = residue.simhashes(texts)
    for t, row in zip(texts, got):
        code = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        h = nearcopies.gram_hashes(code, min(5, max(1, len(code)))) if len(code) else np.zeros(0, np.uint64)
        for w, salt in enumerate(residue._SALTS):
            with np.errstate(over="ignore"):
                m = (h ^ (h >> np.uint64(32))) * salt
            m ^= m >> np.uint64(29)
            assert int(row[w]) == sum(1 << b for b in range(64) if 2 * int(((m >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_slices_keep_all_rows(monkeypatch):
    import pyarrow as pa

    from brinewell.llm import batches

    monkeypatch.setattr(batches, "SLICE", 10)
    texts = ["abc", None, "x" * 30, "", "abcdefgh", "ab", None]
    got = [b.column("t").to_pylist() for b in batches.slices([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"]), pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["t"])], "t")]
    assert sum(got, []) == texts
    assert all(len(g) == 1 or sum(len(x or "") for x in g) <= 10 for g in got if "x" * 30 not in g)


def test_queries_module():
    from brinewell.llm import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert F is not None
