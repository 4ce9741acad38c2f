"""Chat, media, archives, near-duplicates, mixing, nearest neighbours and the pipeline: against brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stillwater.llm import ann, chat, media, minhash, mixing, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(draw, n, vocabulary=300):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


# --------------------------------------------------------------------------- chat


def test_preferences(spark):
    turns = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "no"), (2, 0, "user", "hi <|end|>"), (2, 1, "assistant", "é"), (3, 0, "user", "hi <|end|>"), (3, 1, "assistant", "yes"), (4, 0, None, None), (None, 0, "user", "x"), (5, 0, "a|b", "")]
    df = spark.createDataFrame([(*t, "kept out") for t in turns], "conv_id bigint, turn bigint, role string, text string, prompt string")
    chats = chat.conversations(df)
    made = chat.format_preferences(chat.pairs_by_opening(chats).union(chat.pairs_by_answer(chats)))
    got = {(r["kind"], r["chosen_id"], r["rejected_id"]): r for r in made.collect()}
    assert set(got) == {("opening", 1, 2), ("opening", 1, 3), ("answer", 1, 1)}
    one = got["opening", 1, 2]
    assert one["n_common"] == 1 and one["prompt"] == "<|user|>\nhi <||end|><|end|>\n"
    assert one["rejected_text"] == "<|assistant|>\né<|end|>\n"
    assert [one["rejected_text"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["é<|end|>\n"]
    assert [one["chosen_text"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["yes<|end|>\n", "no<|end|>\n"]
    assert got["opening", 1, 3]["rejected_text"] == "" and got["opening", 1, 3]["n_common"] == 2
    assert got["answer", 1, 1]["n_common"] == 3 and got["answer", 1, 1]["rejected_text"] == "<|assistant|>\nyes<|end|>\n"
    assert chat.format_preferences(chat.pairs_by_opening(chat.conversations(df.limit(0)))).count() == 0


# --------------------------------------------------------------------------- media


def test_media_round_trip(spark):
    texts = [None, "", "a" * 64, "é<b>&amp; \n second\nthird", "x" * 100_000, "a" * 64]
    docs = spark.createDataFrame([(i, t, "cap <1>", "old") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, digest string")
    seen = {r["digest"]: r for r in media.examine(media.store(docs)).collect()}
    assert len(seen) == 4  # null and empty are one, and so are equal texts
    for t in texts:
        payload = media.pad((t or "").encode())
        r = seen[hashlib.sha256(payload).hexdigest()]
        assert len(payload) % 64 == 0 and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert media.from_png(media.to_png(payload)) == payload
    pages = docs.select("doc_id", media.as_page(F.col("text"), F.col("source")).alias("html"))
    items = {r["doc_id"]: r["items"] for r in media.sequences(pages, keep=("doc_id",)).collect()}
    assert [(x["kind"], x["text"]) for x in items[3]] == [("text", "é<b>&amp;"), ("image", None), ("text", "second"), ("text", "third")]
    assert items[3][1]["caption"] == "cap <1>" and items[3][1]["position"] == 1
    refs = media.resolve(media.references(media.sequences(pages, keep=("doc_id",)), ("doc_id",)), media.examine(media.store(docs)))
    assert {r["doc_id"] for r in refs.where("payload_sha256 = digest").collect()} == set(range(6))
    damaged = bytearray(media.to_png(bytes(64)))
    damaged[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(damaged))


def test_pages_are_parsed_in_order():
    html = '<html><head><title>no</title></head><p>a <b>b</b></p><script>x<p></script><figure><img src="u.png" alt="alt"><figcaption>c</figcaption></figure>tail<img src=v>'
    assert [(x["kind"], x["text"] or x["source"], x["caption"]) for x in media.parse(html)] == [("text", "a b", None), ("image", "u.png", "alt c"), ("text", "tail", None), ("image", "v", None)]
    assert media.parse(None) == [] == media.parse("")


# --------------------------------------------------------------------------- archives


def test_archives(spark):
    big = "<p>" + "z" * 2000
    pages = [(1, "u\r\nX: y", big), (2, None, big), (3, "v", "small"), (4, "v", "small"), (5, "w", None), (6, "w", "é" * 600), (None, "n", big), (7, "q", "WARC/1.1\r\n\r\n" * 90)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload_bytes int").repartition(2)
    members = warc.normalise(warc.write_archives(warc.plan_records(df), archive_bytes=3000)).cache()
    got = {r["page_id"]: r for r in warc.read_records(members).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        payload = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert got[i]["record_type"] == ("revisit" if i in (1, None) else "response")
        assert got[i]["refers_to"] == (2 if i in (1, None) else None)
    for row in members.collect():
        for line in row["sidecar"].split("\n"):
            _, at, n = map(int, line.split())
            assert zlib.decompress(row["data"][at : at + n], 31).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.cut_stream(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", wbits=31)))
    assert warc.read_records(warc.normalise(warc.write_archives(warc.plan_records(df.limit(0))))).count() == 0


# --------------------------------------------------------------------------- near-duplicates


def brute_components(texts, width):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n * 100 >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "few"), [(2, 16), (5, 0)])
def test_near_duplicates(spark, width, few):
    draw = random.Random(width)
    base = text_of(draw, 90).split()
    texts = [None, "", "  ", "One", "one", "two words", "Two  words", text_of(draw, 3000)]
    for _ in range(60):  # near copies of one text, some too far from all others
        w = list(base)
        for _ in range(draw.choice([1, 2, 3, 6, 9])):
            w[draw.randrange(len(w))] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5 + [text_of(draw, 40, 12) for _ in range(40)] + [" ".join([*base[:40], text_of(draw, 50, 10**6)]) for _ in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(None, " ".join(base), 7), (8, texts[8], 7)], "doc_id bigint, text string, id int")
    got = minhash.near_duplicates(df, width, few=few).collect()
    assert len(got) == len(rows) + 2
    want = brute_components(rows, width)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_few_tasks(spark):
    """Each shuffle is a task for each partition, however few rows there are, so the rounds must not shuffle again and again."""
    draw = random.Random(3)
    base = text_of(draw, 90).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(draw.choice([1, 3, 6, 9])):
            w[draw.randrange(len(w))] = f"n{draw.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "")
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2, few=0).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2).items()}
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    shuffles = sum(1 for s in stages if (i := tracker.getStageInfo(s)) and i.numTasks >= 12 and i.numCompletedTasks)
    assert shuffles <= 100, shuffles


def near_pairs_among_others(draw, others):
    """Texts of which the first 12 are near copies by twos, and the links that are so found."""
    texts = []
    for k in range(0, 12, 2):
        w = others(draw).split()
        texts += [" ".join(w), " ".join([*w[:-1], f"last{k}"])]
    return texts, {i: i - i % 2 for i in range(12)}


def test_only_wanted_texts_are_moved(spark):
    """Full sets are made of few documents, so the texts of the others must not go through shuffles, however many rounds there are."""
    draw = random.Random(5)
    texts, links = near_pairs_among_others(draw, lambda d: text_of(d, 3000, 10**6))
    texts += [text_of(draw, 3000, 10**6) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in (lambda all_: (all_.apply(i) for i in range(all_.size())))(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = written()
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == {i: links.get(i, i) for i in range(len(texts))}
    assert moved < 0.5 * sum(map(len, texts)), moved


@pytest.mark.parametrize("short", [64, 1])
def test_chance_agreements_go_no_further(spark, monkeypatch, short):
    """Of a small vocabulary all elements are shared, but few documents are alike: lists (of few classes) and blocks keep these."""
    draw = random.Random(6)
    some = lambda d: text_of(d, 60, 25)
    texts, _ = near_pairs_among_others(draw, some)
    texts += [some(draw) for _ in range(300)]
    rows = {}
    kept = minhash.common.stash

    def counted(df, label, codec="zstd"):
        made = kept(df, label, codec)
        rows.setdefault(label, []).append(made.count())
        return made

    monkeypatch.setattr(minhash.common, "stash", counted)
    monkeypatch.setattr(minhash, "SHORT", short, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2, few=0).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 2).items()}
    assert rows["minhash-postings"][0] < 1000 if short == 64 else rows["minhash-block-sets"][0] < 50, rows


def test_rows_of_one_id_are_one_node(spark):
    a, b = "a b c d e f g h", "i j k l m n o p"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id bigint, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1}


# --------------------------------------------------------------------------- mixing


def test_one_response_for_repeated_pages(spark):
    a, b = "a" * 1000, "b" * 2000
    pages = [(3, "x", a), (3, "x", a), (3, "w", a), (3, None, a), (1, "x", a), (None, None, b), (None, None, b), (7, "x", "short"), (7, "x", "short"), (8, "x", "c" * 1500)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = warc.plan_records(df).collect()
    assert sorted((str(r["page_id"]), str(r["url"])) for r in got) == sorted((str(i), str(u)) for i, u, _ in pages)
    for text, kept, n in ((a, 3, 5), (b, None, 2)):
        mine = [r for r in got if bytes(r["payload"]) == text.encode()]
        assert len(mine) == n and [r["page_id"] for r in mine if r["record_type"] == "response"] == [kept]
        assert {r["refers_to"] for r in mine if r["record_type"] == "revisit"} == {kept}
    assert all(r["record_type"] == "response" for r in got if r["page_id"] in (7, 8))


def test_mixing(spark):
    draw = random.Random(4)
    sizes = {"a": 300, "b": 40, "c": 200, None: 60}
    rows = [(len(s) * 100_000 + i if s else i, s, text_of(draw, draw.randint(1, 30))) for s, n in sizes.items() for i in range(n)]
    rows += [(9, "z", None), (9, "z", None), *[(None, "a", "x y")] * 50, *[(None, None, f"{i} y") for i in range(50)]]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, source string, text string, target double")
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["n_copies"] and all(0 <= p <= 1 for p in r["positions"])
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= 30
    order = sorted((k, p) for r in got for k, p in zip(r["ranks"], sorted(r["positions"]), strict=True))
    assert [k for k, _ in order] == list(range(len(order))) and [p for _, p in order] == sorted(p for _, p in order)
    again = sorted((str(r["doc_id"]), r["source"] or "", r["taken"]) for r in mixing.plan(df.repartition(3)).collect())
    assert again == sorted((str(r["doc_id"]), r["source"] or "", r["taken"]) for r in got)
    stream = mixing.mix(df)
    assert stream.columns == df.columns and stream.count() == sum(r["n_copies"] for r in got)
    assert mixing.plan(df.limit(0)).count() == 0
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id")).alias("source"), F.repeat(F.lit("a "), (F.col("id") % 9).cast("int")).alias("text"))
    full = mixing.plan(many).collect()
    assert len(full) == 700 and abs(sum(r["target"] for r in full) - 1.5 * sum(r["size"] for r in full)) < 1e-6
    assert all(r["target"] <= 2 * r["size"] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in full)


def test_mixed_documents_move_once(spark, capsys):
    """Positions move to the documents, not both to each other; every copy has all columns of its row, whatever their names."""
    rows = [(i % 90 or None, f"s{i % 3}", f"word{i} " * (i % 7), i, [i]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, `a.b, c` int, held_ array<int>")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stream = mixing.mix(df)
        stream.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning(row") == 1
        assert stream.schema == df.schema
        got = Counter(tuple(map(str, r)) for r in stream.collect())
        want = Counter()
        for r in mixing.plan(df).collect():
            want[str(r["doc_id"]), r["source"], r["size"]] += r["n_copies"]
        assert set(got) <= {tuple(map(str, r)) for r in rows} and max(got.values()) <= 2
        by_key = Counter()
        for (doc, source, text, *_), n in got.items():
            by_key[doc, source, len(text.split())] += n
        assert by_key == +want
        assert mixing.mix(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def plain_filling(sizes, weights, share, most):
    """Targets by raising the level of all sources that are not full, step by step."""
    targets, left, open_ = [0.0] * len(sizes), share * sum(sizes), {i for i, s in enumerate(sizes) if s}
    while open_ and left > 1e-9:
        x = min(left / sum(weights[i] for i in open_), min((most * sizes[i] - targets[i]) / weights[i] for i in open_))
        for i in open_:
            targets[i] += weights[i] * x
            left -= weights[i] * x
        open_ = {i for i in open_ if targets[i] < most * sizes[i] - 1e-9}
    return targets


def test_targets_fill_like_water(spark):
    draw = random.Random(2)
    for n in (1, 2, 5, 40):
        sizes = [int(draw.paretovariate(0.6)) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = plain_filling(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2)
        assert all(abs(got[f"s{i:03d}"] - t) < 1e-6 * max(1, t) for i, t in enumerate(want))


# --------------------------------------------------------------------------- nearest neighbours


def test_nearest(spark):
    draw = np.random.default_rng(6)
    v = draw.normal(size=(900, 12)) * draw.uniform(0.5, 2, (900, 1))
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(2000, None, 0), (2001, [0.0] * 12, 0), (2002, [1.0, None] + [0.0] * 10, 0), (2003, [float("nan")] * 12, 0), (2004, [float("inf")] * 12, 0), (None, [1.0] * 12, 0), (2005, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(900), -s)).tolist() if i != q][:10]
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(abs(x - s[i]) < 1e-9 for _, i, x in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits >= 0.9 * 10 * len(got)
    other = spark.createDataFrame([(i, [float(i % 7) + 1, 1.0], 0) for i in range(2020, 2060)], df.schema)
    mixed = ann.nearest(df.where("vec_id < 300 or vec_id > 1999").union(other), F.col("vec_id") % 20 == 0, k=10, shard_rows=100).collect()
    assert {r["query_id"] for r in mixed} == {*range(0, 300, 20), 2020, 2040}
    for q in (2020, 2040):  # their candidates are the vectors of their length
        want = sorted(((-((i % 7 + 1) * (q % 7 + 1) + 1), i) for i in range(2020, 2060) if i != q))[:10]
        assert [(-s, i) for s, i in want] == sorted(((r["score"], r["vec_id"]) for r in mixed if r["query_id"] == q), key=lambda x: (-x[0], x[1]))
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_rows(spark):
    draw = np.random.default_rng(8)
    near = draw.normal(size=6)
    near /= np.linalg.norm(near)
    data = [(i, near.tolist()) for i in range(100, 130)] + [(i, draw.normal(size=6).tolist()) for i in range(40)]
    data += [(7, (near * (3 + i / 300)).tolist()) for i in range(200)]  # an id with more vectors than a beam has places

    def brute(k):
        out = {}
        for q in {i for i, _ in data if i % 20 == 0}:
            best = {}
            v = next(np.array(x) for i, x in data if i == q)
            for i, x in data:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), round(float(np.array(x) @ v), 9))
            out[q] = sorted(best, key=lambda i: (-best[i], i))[:k]
        return out

    want = brute(20)
    tables = {"once": data, "doubled": data * 2, "25 copies of one": data + [data[1]] * 24, "25 copies of a query": data + [data[0]] * 24}
    for name, table in tables.items():
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(df.repartition(40), F.col("vec_id") % 20 == 0, k=20, blocks_at_once=1).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
        times = Counter(i for i, _ in table)
        assert {q: sorted({i for _, i, _ in x}) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}, name
        assert all(len(x) == 20 * times[q] for q, x in got.items()), name


def test_blocks_of_late_partitions(spark):
    """Numbers of blocks in partitions beyond the thousandth need more than 42 bits."""
    far = spark.range(3).select((F.col("id") + 1).alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    layout = ann.Layout.of(far, 10)
    blocks = ann.query_blocks(far).withColumn("block", F.lit(5000 << 33))
    got = ann.search_shards(ann.build_indexes(far, layout), blocks, layout, 2).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in got} == {(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0), (2, 3, 3.0), (3, 1, 1.0), (3, 2, 3.0)}
    assert {r["block"] for r in got} == {5000 << 33}


# --------------------------------------------------------------------------- pipeline


def test_near_copies_go_by_row(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    rows = [(1, a), (1, None), (5, a), (5, b), (9, b), (None, c), (None, c), (2, ""), (2, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row_ int")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, a), (1, None), (5, b), (None, c), (2, ""), (2, "")], key=str)


def test_pipeline(spark, tmp_path):
    draw = random.Random(8)
    texts = [text_of(draw, 60, 5000) + (" zwurk blorgix" if i % 6 == 0 else "") for i in range(240)]
    texts += [texts[1], texts[2] + " end", "write to ann@example.com " + text_of(draw, 40, 5000), None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = at.cache()
        seen[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    assert not [i for i in seen["toxicity"] if i % 6 == 0 and i < 240] and len(seen["toxicity"]) == 204 - 0
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {240, 241}
    assert "[EMAIL]" in seen["personal_data"][242] and seen["personal_data"][243] is None
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() > 0 and set(final.columns) >= {"doc_id", "n_tokens", "ids_sha256"}
