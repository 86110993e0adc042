import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("knotwork.llm")
from knotwork.llm import cooccur, handwritten, lookalike, neardup, packing, syntax, termfreq, tokenise  # noqa: E402


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# -- near duplicates


def words(text):
    return frozenset(re.findall("[a-z0-9]+", text.lower()))


def brute_pairs(texts, t=0.6):
    out = []
    for i, a in texts.items():
        for j, b in texts.items():
            if i < j and a is not None and b is not None:
                x, y = words(a), words(b)
                if a == b or x | y and len(x & y) >= t * len(x | y) - 1e-9:
                    out.append((i, j))
    return sorted(out)


def edited(r, text):
    ws = text.split(" ")
    for _ in range(r.randrange(4)):
        k = r.randrange(3)
        if k == 0 and len(ws) > 1:
            ws.pop(r.randrange(len(ws)))
        elif k == 1:
            ws.insert(r.randrange(len(ws) + 1), f"w{r.randrange(400)}")
        else:
            r.shuffle(ws)
    return " ".join(ws)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    base = [" ".join(r.sample(common, r.randrange(2, 9)) + [f"w{r.randrange(400)}" for _ in range(r.randrange(0, 12))]) for _ in range(60)]
    out = {}
    for i in range(260):
        b = r.choice(base[:8]) if r.random() < 0.4 else r.choice(base)
        out[i] = edited(r, b) if r.random() < 0.7 else b
    out |= {300: None, 301: "", 302: "", 303: "...", 304: "é ü", 305: "ABC-abc", 306: "abc", 307: "K elvin", 310: "\u212a elvin", 311: "\u0130 x y z", 312: "i x y z", 308: " ".join(f"v{i}" for i in range(3000)), 309: " ".join(f"v{i}" for i in range(2, 3002))}
    return out


@pytest.mark.parametrize("seldom, hot, leaf, levels", [(512, 200_000, 20_000, 3), (10, 60, 20_000, 3), (10, 20, 30, 2), (1000, 10**9, 25, 0)])
def test_near_duplicates(spark, texts, monkeypatch, seldom, hot, leaf, levels):
    for n, v in (("SELDOM", seldom), ("HOT", hot), ("LEAF", leaf), ("LEVELS", levels)):
        monkeypatch.setattr(neardup, n, v)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, texts[5], "y")], "id long, text string, words string").withColumn("region", F.lit(1))
    got = rows(neardup.near_duplicate_pairs(df, "id", "text"), "id_a", "id_b")
    assert got == sorted(brute_pairs(texts), key=repr)


def test_near_duplicates_of_unlike_sizes(spark, monkeypatch):
    """Pairs with no more than the needed words in common, all of them frequent, and otherwise words of their own."""
    monkeypatch.setattr(neardup, "SELDOM", 1)
    texts, want = {}, []
    for n in range(2, 46):
        for m in range(n, int(n / 0.6 + 1e-9) + 1):
            i = len(texts)
            both = next(k for k in range(n + 1) if k >= 0.6 * (n + m - k) - 1e-9)
            shared = [f"s{i}x{k}" for k in range(both)]
            texts[i], texts[i + 1] = (" ".join(shared + [f"u{j}x{k}" for k in range(size - both)]) for j, size in ((i, n), (i + 1, m)))
            want.append((i, i + 1))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert sorted(rows(neardup.near_duplicate_pairs(df, "id", "text"), "id_a", "id_b")) == want


def test_near_duplicate_classes(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = neardup.near_duplicate_classes(df, "id", "text").collect()
    pairs = brute_pairs({i: t for i, t in texts.items() if t is not None and words(t)})
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {r["id"]: r["n_links"] for r in got if words(texts[r["id"]])} == {i: links.get(i, 0) for i, t in texts.items() if t is not None and words(t)}
    assert neardup.near_duplicate_classes(df.where("false"), "id", "text").count() == 0


def test_near_duplicates_told_apart_by_more_words(spark, texts, monkeypatch):
    for n, v in (("SELDOM", 10), ("SPLIT", 3)):
        monkeypatch.setattr(neardup, n, v)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert rows(neardup.near_duplicate_pairs(df, "id", "text"), "id_a", "id_b") == sorted(brute_pairs(texts), key=repr)


@pytest.mark.parametrize("seldom", [50, 512])
def test_near_duplicates_store_less_than_their_texts(spark, monkeypatch, seldom):
    """neither the points nor the word sets of all texts are written to the checkpoint folder."""
    monkeypatch.setattr(neardup, "SELDOM", seldom)
    r = random.Random(4)
    texts = {i: " ".join([f"common{x}" for x in r.sample(range(300), 20)] + [f"own{i}x{k}" for k in range(3)]) for i in range(2000)}
    texts[2000] = texts[7] + " more"
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert rows(neardup.near_duplicate_pairs(df.limit(1), "id", "text"), "id_a", "id_b") == []  # names the folder
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = {f for f in folder.rglob("part-*")}
    assert rows(neardup.near_duplicate_pairs(df, "id", "text"), "id_a", "id_b") == [(7, 2000)]
    assert sum(f.stat().st_size for f in folder.rglob("part-*") if f not in before) < sum(map(len, texts.values()))


# -- terms and pairs of items


@pytest.fixture(scope="module")
def tagged(spark):
    r = random.Random(2)
    data = [(r.randrange(300), r.choices(["hot", " Hot\t", "a", "b", "c", None, *[f"k{i}" for i in range(40)]], [60, 30, 20, 20, 15, 5, *[3] * 40])[0]) for _ in range(3000)]
    data += data[:200] + [(None, "a"), (7, None), (999, None), (5, ""), (5, "　")]
    return data, spark.createDataFrame(data, "decision_id long, keyword string").withColumn("term", F.lit("z")).withColumn("record", F.lit(0))


def uniform(k):
    return None if k is None else k.strip().lower()


def test_term_counts(tagged):
    data, df = tagged
    total = len({d for d, _ in data if d is not None})
    want = {}
    for d, k in data:
        if k is not None:
            w = want.setdefault(uniform(k), [0, set()])
            w[0] += 1
            w[1] |= {d} - {None}
    got = {r["term"]: (r["n_rows"], r["n_records"], r["total_records"]) for r in termfreq.term_counts(df, "decision_id", "keyword").collect()}
    assert got == {k: (n, len(s), total) for k, (n, s) in want.items()}
    assert termfreq.term_counts(df.where("false"), "decision_id", "keyword").count() == 0
    marks = {r["term"]: r["mark"] for r in termfreq.marked_terms(df, "decision_id", "keyword").collect()}
    assert marks == {k: "rare" if len(s) < 3 else "common" if len(s) * 20 > total else None for k, (n, s) in want.items()}


@pytest.mark.parametrize("heavy, part", [(128, 256), (3, 4), (0, 2)])
def test_pair_lift(tagged, monkeypatch, heavy, part):
    data, df = tagged
    monkeypatch.setattr(cooccur, "MOST_HEAVY", max(heavy, 1))
    monkeypatch.setattr(cooccur, "PART", part)
    monkeypatch.setattr(cooccur, "HEAVY_SHARE", 0.01 if heavy else 2.0)
    held = {}
    for d, k in data:
        if d is not None and k is not None:
            held.setdefault(uniform(k), set()).add(d)
    n = len({d for d, _ in data if d is not None})
    want = []
    for a in held:
        for b in held:
            ab = len(held[a] & held[b])
            if a < b and ab >= 5 and ab * n >= 2 * len(held[a]) * len(held[b]):
                want.append((a, b, ab, len(held[a]), len(held[b]), n))
    got = rows(cooccur.pair_lift(df, "decision_id", "keyword", least_together=5, lift=2), "item_a", "item_b", "n_ab", "n_a", "n_b", "n")
    assert got == sorted(want, key=repr)
    assert cooccur.pair_lift(df.where("false"), "decision_id", "keyword").count() == 0


# -- source files


def source(i):
    return f"export function f{i}(input, options) {{\n  if (input > {i}) {{\n    return step{i % 7}(input);\n  }}\n  // done {i}\n  const item{i} = options.list.map((x) => load(x));\n  return item{i};\n}}\n"


def test_syntax(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    files = [
        ("r", "r/ok.ts", "let a: number = 1", t), ("r", "r/ok.ts", "let a: = 1", t - dt.timedelta(1)), ("r", "r/bad.ts", "a b", t), ("r", "r/typed.js", "let a: number = 1", t), ("r", "r/jsx.ts", "x = <a>it's</a>", t),
        ("r", "r/null.ts", None, t), ("r", "r/late.js", "a b", None), ("r", "r/late.js", "a", t), (None, "q/x.css", "a b", t), ("r", None, "a b", t), ("r", "r/ok.ts", "let a: number = 1", t), ("r", "r/long.js", "f(1);\n" * 50_000 + "(", t),
    ]
    p = spark.createDataFrame(files, "repo string, file string, source_text string, indexed_at timestamp").withColumn("valid", F.lit(1)).withColumn("lang", F.lit(None).cast("string"))
    runs = spark.createDataFrame([("r", [("r/ok.ts", "e"), ("r/gone.jsx", "e"), ("r/gone.jsx", "f"), (None, "g")]), ("r", None)], "repo string, parse_failures array<struct<file string, error string>>")
    got = rows(syntax.invalid_files(p, runs), "file", "fault")
    assert got == [("r/bad.ts", "corrupt"), ("r/gone.jsx", "unparsed"), ("r/jsx.ts", "wrong_extension"), ("r/long.js", "corrupt"), ("r/typed.js", "wrong_extension")]
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in syntax.invalid_rates(p, runs).collect()}
    assert rates == {("r", "typescript"): (4, 2), ("r", "javascript"): (4, 3)}
    assert syntax.invalid_files(p.where("false"), runs.where("false")).count() == 0


def test_handwritten(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    data, want = [], set()
    for i in range(240):
        repo = f"r{i % 12}"
        data.append((repo, f"{repo}/src/m{i}.js", source(i), t))
        stub = "".join(f"export function get{i}x{k}(body) {{\n  return client.request('POST', '/v1/x{k}', body);\n}}\n" for k in range(12))
        if i % 4 == 0:  # says so, or not
            data.append((repo, f"{repo}/gen/s{i}.js", ("// Code generated by tool. DO NOT EDIT.\n" if i % 8 else "") + stub, t))
            want.add(f"{repo}/gen/s{i}.js")
        if i % 6 == 0:
            data.append((repo, f"{repo}/src/t{i}.js", "// This used to be generated; now we maintain it ourselves.\n" + source(1000 + i), t))
    data += [("r1", "r1/empty.js", "", t), ("r1", "r1/null.js", None, t), ("r1", "r1/comment.js", "// Code generated by tool. DO NOT EDIT.\n", t), ("r1", None, "x", t), ("r1", "r1/gen/cut.js", "// Code generated by tool. DO NOT EDIT.\nexport function getx(body) {\n  return client.request('POST',", t)]
    p = spark.createDataFrame(data, "repo string, file string, source_text string, indexed_at timestamp").withColumn("score", F.lit(1)).withColumn("label", F.lit(1))
    got = {r["file"] for r in handwritten.not_handwritten(p).collect()}
    assert got == want
    assert handwritten.not_handwritten(p.where("false")).count() == 0


def test_classifier_on_held_out_repositories(spark):
    from knotwork.plans.queries import table

    p = table(spark, "/root/testdata/sf0.01", "parsed_files")
    report = handwritten.fit_on(p, handwritten.cut(handwritten._latest(p))).report
    assert report["held"] > 50 and report["precision"] >= 0.9 and report["recall"] >= 0.9
    assert report["precision_without_copies"] >= 0.9


def test_labels_and_bytes_of_the_fit(spark, monkeypatch):
    assert handwritten.own_label("r/a.js", "/*! kit v1.2.3 */", "x()") == 1
    assert handwritten.own_label("r/a.js", "// since 1.2.3\n", "x()") == 0
    assert handwritten.own_label("r/vendor/a.js", "", "x()") is None
    assert handwritten.own_label("r/a.js", "// HEADER is written by hand\n", "const H = '// Code generated by x. DO NOT EDIT.'") == 0
    p = spark.read.parquet("/root/testdata/sf0.001/parsed_files.parquet")
    latest = handwritten.cut(handwritten._latest(p))
    monkeypatch.setattr(handwritten, "FIT_BYTES", 1)
    assert handwritten.fit_on(p, latest).report == {"rows": 0}


# -- tokens


def test_tokens_against_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenise.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(4)
    alphabet = "aab bc  \n\t'sdé日本👍\xa0　1234.,!?ABCthe ing er‍\r\x1c"
    given = ["", " ", "\n\n  a", "<|endoftext|> x", "it's we'll I'M", "aaaa" * 500, "the" * 3000, "\x1c\x1d x", "١٢٣ ½²", "ﬁ K"] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(given)] + [(9999, None, 1)], "doc_id long, text string, ids int").withColumn("key", F.lit(1))
    got = {x["doc_id"]: list(x["ids"]) for x in tokenise.encode(df, "doc_id", "text").collect()}
    assert got.pop(9999) == []
    want = {i: e.ids for i, e in enumerate(t.encode_batch(given, add_special_tokens=False))}
    assert got == want
    counts = {x["doc_id"]: x["tokens"] for x in tokenise.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(v) for i, v in want.items()} | {9999: 0}
    assert tokenise.encode(df.where("false"), "doc_id", "text").count() == 0


# -- packing


def test_plan_places_every_item_once():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([5, 10, 30, 100])
        items = [r.randint(1, capacity) for _ in range(r.randrange(60))]
        counts = {x: items.count(x) for x in items}
        events, used, fixed = packing.plan(counts, capacity)
        load, seen = {}, set()
        for s, a, b, first, each in events:
            for x in range(a, b):
                assert (s, x) not in seen
                seen.add((s, x))
                bin_ = first + (x - a) // each
                load[bin_] = load.get(bin_, 0) + s
        assert len(seen) == len(items) and set(load) == set(range(used)) and fixed <= used
        assert all(v <= capacity for v in load.values())
        assert used <= 2 * -(-sum(items) // capacity)


def fewest(items, capacity):
    """Containers needed, by trying all."""
    best = len(items)

    def go(left, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not left:
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= left[0]}:
            go(left[1:], [*(rooms[: rooms.index(r)]), r - left[0], *rooms[rooms.index(r) + 1 :]])
        go(left[1:], [*rooms, capacity - left[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_plan_fixes_only_what_is_best():
    assert packing.plan({60: 1, 35: 1, 17: 1, 16: 1}, 100)[1:] == (2, 2)  # the largest one beats any two
    assert packing.plan({60: 1, 22: 1, 17: 1, 16: 1}, 100)[2] >= 1  # an item and the largest two
    assert packing.plan({4: 900}, 12)[1:] == (300, 300)
    r = random.Random(12)
    for _ in range(1500):
        capacity = r.randrange(8, 40)
        items = [r.randrange(1, capacity + 1) if r.random() < 0.3 else r.randrange(max(1, capacity // 6), capacity // 2 + 1) for _ in range(r.randrange(1, 9))]
        counts = {s: items.count(s) for s in items}
        events, used, fixed = packing.plan(counts, capacity)
        rest = [s for s, a, b, first, each in events for x in range(a, b) if first + (x - a) // each >= fixed]
        assert fewest(items, capacity) == fixed + fewest(rest, capacity) if rest else fewest(items, capacity) == fixed == used


def test_pack(spark):
    sizes = [(i, s) for i, s in enumerate([0, 1, 9, 10, 11, 20, 25, 5, 5, None, 3, 7] + [4] * 200)] + [(2, 9), (None, 3)]
    items = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("part", F.lit("x"))
    windows = spark.createDataFrame([(1, 10), (2, 100), (2, 100), (3, 0), (None, 5)], "window_id int, capacity int").withColumn("tokens", F.lit(1))
    got = packing.pack(items, windows).collect()
    for w, c in ((1, 10), (2, 100)):
        mine = [r for r in got if r["window_id"] == w]
        load, docs = {}, {}
        for r in mine:
            load[r["bin"]] = load.get(r["bin"], 0) + r["tokens"]
            docs.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
        assert max(load.values()) <= c
        want = {i: s or 0 for i, s in sizes if i is not None}
        assert {i: sum(t for _, t in v) for i, v in docs.items()} == want
        assert all(len(v) == max(1, -(-want[i] // c)) and sorted(p for p, _ in v) == list(range(len(v))) for i, v in docs.items())
    assert {r["window_id"] for r in got} == {1, 2}
    assert packing.pack(items.where("false"), windows).count() == 0
    room = {r["window_id"]: r["unused"] for r in packing.room_left(packing.pack(items, windows), windows.where("window_id < 3")).collect()}
    assert room[2] < 100


# -- look-alikes


def test_look_alikes(spark):
    same = [
        ("plain text - fi", ["ｐｌａｉｎ text - fi", "рlаіn tехt - fi", "plain text - fi", "pl​a­in text ‑ ﬁ", "plain\ttext　- f⁠i"]),
        ("café größe", ["café größe", "cаfé größe"]),
        ("バーが ピ", ["ﾊﾞｰが ﾋﾟ", "バーが ピ"]),
        ("ё and ï", ["ё and ї", "ë and ї"]),
        ("\U0001f469‍\U0001f4bb x", ["\U0001f469‍\U0001f4bb x"]),
    ]
    other = ["plain text - f1", "Plain text - fi", "plain texт² - fi", "plain  text - fi", "cafè größe", "café grösse", "\U0001f469\U0001f4bb x", "ハーか ピ", "m2", "m²", "a pAir of l’s. Q", "a pair of l's. Q", "a pAir of I's. Q", "a pAır of l's. Q", "a pAir of 1's. Q", "a pAir 0f l's. Q", "a pÂir of l's. Q", "", " ", "​", "　‍", None]
    data = [(100 * n + k, t) for n, (a, bs) in enumerate(same) for k, t in enumerate([a, a, *bs])] + [(1000 + i, t) for i, t in enumerate(other)] + [(None, "plain text - fi"), (0, same[0][0])]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("look", F.lit(1)).withColumn("key", F.lit(2))
    want = sorted((a, b) for n, (base, bs) in enumerate(same) for a in range(100 * n, 100 * n + 2 + len(bs)) for b in range(a + 1, 100 * n + 2 + len(bs)) if not (a == 100 * n and b == 100 * n + 1))
    assert rows(lookalike.look_alike_pairs(df, "doc_id", "text"), "id_a", "id_b") == sorted(want, key=repr)
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lookalike.look_alike_classes(df, "doc_id", "text").collect()}
    assert classes[0] == (0, 5) and classes[2] == (0, 6) and 1000 not in classes
    uniform_ = {r["doc_id"]: r["uniform"] for r in lookalike.uniform_text(df.where("doc_id is not null"), "doc_id", "text").collect()}
    assert uniform_[1] == uniform_[4] and uniform_[1021] is None and uniform_[1017] == ""
    assert lookalike.look_alike_pairs(df.where("false"), "doc_id", "text").count() == 0


def test_rewriting_settles_and_is_one_form(spark):
    r = random.Random(8)
    groups, nothing = lookalike.look_alikes(spark)
    members = [m for g in groups for m in g if len(g) < 12]
    text = ["".join(r.choice([r.choice(members), r.choice("abc éх\n"), r.choice(nothing)]) for _ in range(40)) for _ in range(50)]
    rules = lookalike.representatives(spark.createDataFrame([(t,) for t in text], "t string"), "t")
    rewrite = lookalike.Rewriter(rules)
    for t in text:
        u = rewrite(t)
        assert rewrite(u) == u and rewrite(unicodedata.normalize("NFD", t)) == u
