from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import cache as C
from pagemill.operators import diff as D
from pagemill.operators import export as X
from pagemill.operators import library as L
from pagemill.operators import merge as M
from pagemill.operators import ordered as O
from pagemill.operators import schedule as G
from pagemill.operators import tasks as K
from pagemill.sources import tables as S

CHAPTER = "book_id string, source_chapter_id string, url string, index long, title string"


def diff(spark, local, remote):
    out = D.chapter_diff(spark.createDataFrame(local, CHAPTER), spark.createDataFrame(remote, CHAPTER))
    return sorted((r["change_kind"], r["title"] if r["title"] is not None else r["old_title"]) for r in out.collect())


def rows(*items):
    return [("b", sid, url, i, title) for i, (sid, url, title) in enumerate(items)]


def test_diff_kinds(spark):
    old = rows(("1", "https://a/1", "one"), ("2", "https://a/2", "two"), ("3", "https://a/3", "three"))
    new = rows(("1", "https://a/1?utm_x=1", "one"), ("2", "https://a/2", "two!"), ("4", "https://a/4", "four"))
    assert diff(spark, old, new) == [("changed", "two!"), ("missing", "three"), ("new", "four"), ("unchanged", "one")]
    assert diff(spark, old, old) == [("unchanged", t) for t in ("one", "three", "two")]
    assert diff(spark, [], new) == [("new", t) for t in ("four", "one", "two!")]


def test_diff_matches_by_url_without_id(spark):
    old = rows(("1", "https://a/1", "one"))
    assert diff(spark, old, rows((None, "https://a/1/", "one"))) == [("unchanged", "one")]


def in_order(local, remote):
    """The rule in words: remote rows pick in order, strongest key first, a key stands for its first local row."""
    index = {}
    keys = lambda r: [k for k in (r[1] and f"sid:{r[1]}", r[2] and f"url:{r[2]}") if k] or [f"idx:{r[3]}:{r[4]}"]
    for r in local:
        for k in keys(r):
            index.setdefault((r[0], k), r[3])
    taken, out = set(), {}
    for r in remote:
        for k in keys(r):
            hit = index.get((r[0], k))
            if hit is not None and (r[0], hit) not in taken:
                taken.add((r[0], hit))
                out[(r[0], r[3])] = hit
                break
    return out


def test_contested_matches_equal_the_sequential_rule(spark):
    rng = random.Random(11)
    local, remote = [], []
    for b in range(60):
        for side in (local, remote):
            for i in range(rng.randint(0, 7)):
                side.append((f"b{b}", rng.choice([None, *"1234"]), rng.choice(["", *[f"https://a/{k}" for k in range(4)]]), i, f"t{i % 2}"))
    for whole in (0, 4, D.WHOLE):  # all in rounds, some books in one task, all in one task
        got = D.match_chapters(spark.createDataFrame(local, CHAPTER), spark.createDataFrame(remote, CHAPTER), whole=whole)
        assert {(r["book_id"], r["r"]): r["l"] for r in got.collect()} == in_order(local, remote)


def test_a_shifted_catalogue_needs_few_checkpoints(spark, monkeypatch):
    from pagemill.operators import diff as module

    taken, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: taken.append(1) or cut(df))
    local = [("b", str(i), f"https://a/{i}", i, "t") for i in range(2000)]
    remote = [("b", str(i + 1), f"https://a/{i}", i, "t") for i in range(2000)]
    got = D.match_chapters(spark.createDataFrame(local, CHAPTER), spark.createDataFrame(remote, CHAPTER))
    assert {(r["book_id"], r["r"]): r["l"] for r in got.collect()} == in_order(local, remote)
    assert len(taken) <= 3


def test_diff_partitions_both_sides(spark):
    old, new = rows(*[(str(i), f"https://a/{i}", "t") for i in range(20)]), rows(*[(str(i), f"https://a/{i}", "t") for i in range(5, 30)])
    kinds = diff(spark, old, new)
    assert sum(k != "missing" for k, _ in kinds) == 25
    assert sum(k not in ("new",) for k, _ in kinds) == 20


@pytest.mark.parametrize("limit", [0, 1, 500, 2500, 10**9])
def test_eviction_against_brute_force(spark, limit):
    rng = random.Random(limit)
    entries = [(f"k{i}", rng.randint(0, 90), rng.choice([0, 0, 0, 1, 86_400, 10**6])) for i in range(120)]
    df = spark.createDataFrame(entries, "key string, size_bytes long, s long").withColumn("accessed_at", F.timestamp_seconds("s")).withColumn("d", F.md5("key"))
    got = {r["key"]: r["evicted"] for r in C.evict_lru(df, limit).collect()}
    total, gone = sum(e[1] for e in entries), set()
    digests = {r["key"]: r["d"] for r in df.collect()}
    if limit > 0:
        for key, size, at in sorted(entries, key=lambda e: (e[2], digests[e[0]])):
            if total <= limit:
                break
            gone.add(key)
            total -= size
    assert {k for k, v in got.items() if v} == gone


@pytest.mark.parametrize("width", [1, 7, 1000, None])
def test_ranged_windows_equal_plain_ones(spark, width):
    rng = random.Random(width or 0)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 3)}", rng.randint(-50, 200), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, at long, id long, v long")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("at", "id")
    want = {r["id"]: (r["s"], r["n"], r["p"]) for r in df.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p")).collect()}
    sums = O.running_sums(df, ["k"], ["at", "id"], width, {"s": F.col("v"), "n": F.lit(1)})
    out = O.neighbours(sums, ["k"], ["at", "id"], width, {"p": "v"})
    assert {r["id"]: (r["s"], r["n"], r["p"]) for r in out.collect()} == want


def test_sampled_ranges_cut_through_ties(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.lit(7).alias("at"), "id")
    ranged = O.with_ranges(df, ["k"], ["at", "id"], ranges=1024)
    sizes = [r["count"] for r in ranged.groupBy(O.RANGE).count().collect()]
    assert len(sizes) > 500 and max(sizes) < 200
    assert O.row_numbers(df, ["k"], ["at", "id"], None).filter(F.col("rn") != F.col("id") + 1).count() == 0


@pytest.mark.parametrize("width", [7, None])
def test_politeness_schedule_equals_the_recurrence(spark, width):
    rng = random.Random(2)
    data = [(f"s{rng.randint(0, 2)}", float(rng.randint(0, 60)), i) for i in range(200)]
    df = spark.createDataFrame(data, "source_id string, arrival double, request_id long")
    want, last = {}, {}
    for s, a, i in sorted(data, key=lambda x: (x[1], x[2])):
        last[s] = max(a, last.get(s, -1e9) + 0.5)
        want[i] = last[s]
    got = {r["request_id"]: r["start_at"] for r in G.politeness_schedule(df, 0.5, width=width).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_throttle_examples(spark):
    data = [("t", 1, 0.0, 0, 100), ("t", 2, 0.4, 50, 100), ("t", 3, 1.2, 60, 100), ("t", 4, 1.5, 100, 100)]
    df = spark.createDataFrame(data, "task_id string, event_id long, at double, done int, total int")
    assert [r["done"] for r in K.throttle_progress(df).orderBy("event_id").collect()] == [0, 60, 100]


def test_throttle_against_brute_force(spark):
    rng = random.Random(9)
    data, clock = [], {}
    for i in range(600):
        t = rng.choice("aaab")
        clock[t] = clock.get(t, 0.0) + rng.choice([0.1, 0.3, 0.6, 1.0, 3.0])
        data.append((t, i, round(clock[t], 3), rng.choice([1, 1, 1, 10]), 10))
    want, kept = set(), {}
    for t, i, at, done, total in data:
        if t not in kept or done >= total or at - kept[t] >= 1.0:
            want.add(i)
            kept[t] = at
    df = spark.createDataFrame(data, "task_id string, event_id long, at double, done int, total int")
    assert {r["event_id"] for r in K.throttle_progress(df, width=5).collect()} == want


@pytest.mark.parametrize(
    ("src", "dst", "ok"),
    [("pending", "running", True), ("running", "success", True), ("paused", "pending", True), ("retrying", "failed", True),
     ("success", "running", False), ("failed", "pending", False), ("cancelled", "running", False), ("pending", "success", False)],
)
def test_transitions(one, src, dst, ok):
    assert one(K.transition_allowed(F.lit(src), F.lit(dst))) is ok


def test_lineage_of_long_chains_and_circles(spark):
    data = [("t0", None)] + [(f"t{i}", f"t{i - 1}") for i in range(1, 40)] + [("x", "y"), ("y", "x"), ("lone", "unknown")]
    out = K.retry_lineage(spark.createDataFrame(data, "task_id string, parent_task_id string"), max_rounds=8)
    got = {r["task_id"]: (r["root_task_id"], r["retries"]) for r in out.collect()}
    assert got["t39"] == ("t0", 39) and got["t0"] == ("t0", 0) and got["lone"] == ("lone", 0)
    assert got["x"][0] is None and got["y"][0] is None


def test_merge_twice_is_a_no_op(spark):
    at = F.timestamp_seconds(F.lit(1))
    base = spark.createDataFrame([("i1", "b", "1", "https://a/1", 0, "one", "x"), ("i2", "b", None, "https://a/2", 1, "two", "y")],
                                 "id string, book_id string, source_chapter_id string, url string, index long, title string, content string")
    base = base.withColumns({"created_at": at, "updated_at": at})
    once = M.upsert_chapters(base, base.withColumn("id", F.lit("other")))
    assert {(r["id"], r["merge_action"]) for r in once.collect()} == {("i1", "update"), ("i2", "update")}
    again = M.upsert_chapters(once.drop("merge_action"), base)
    assert again.drop("merge_action").exceptAll(once.drop("merge_action").select(again.drop("merge_action").columns)).count() == 0


def test_retitled_chapter_keeps_its_id(spark):
    at = F.timestamp_seconds(F.lit(1))
    base = spark.createDataFrame([("i1", "b", "1", "https://a/1", 0, "one")], "id string, book_id string, source_chapter_id string, url string, index long, title string")
    base = base.withColumns({"created_at": at, "updated_at": at})
    new = base.withColumns({"id": F.lit("n"), "title": F.lit("uno")})
    assert [(r["id"], r["title"]) for r in M.upsert_chapters(base, new).collect()] == [("i1", "uno")]


def test_search_edges(spark):
    ch = spark.createDataFrame([("b1", "c1", 1, "t", "has 100% sure"), ("b1", "c0", 0, "t", "has 1000 sure"), ("b2", "c2", 0, "t", "100% too")],
                               "book_id string, id string, index int, title string, content string")
    books = spark.createDataFrame([("b1", "B1"), ("b2", "B2")], "id string, title string")
    assert [r["chapter_id"] for r in L.search_library(ch, books, "100%").collect()] == ["c1", "c2"]
    assert [r["chapter_id"] for r in L.search_library(ch, books, "100%", book_id="b2").collect()] == ["c2"]
    assert L.search_library(ch, books, "").count() == 0
    assert L.search_library(ch, books, "sure", limit=1).count() == 1


def export_tables(spark):
    books = spark.createDataFrame([("b", "S", "sb", "T & co", "Auth", "Intro", None, "unknown", "last", {"publisher": "P"}), ("e", "S", "se", "Empty", "", None, "en", "unknown", None, {})],
                                  "id string, source_id string, source_book_id string, title string, author string, intro string, language string, status string, latest_chapter string, metadata map<string,string>")
    books = books.withColumns({"created_at": F.timestamp_seconds(F.lit(0)), "updated_at": F.timestamp_seconds(F.lit(86400))})
    chapters = spark.createDataFrame([("b", i, f"C{i}", "" if i == 2 else f"p{i}\n\nq < {i}") for i in range(3)], "book_id string, index long, title string, content string")
    return books, chapters


def whole(pieces, book, part):
    return "".join(r["content"] for r in pieces.filter((F.col("book_id") == book) & (F.col("part") == part)).orderBy("ord").collect())


def test_text_export(spark):
    pieces = X.export_txt(*export_tables(spark))
    rule = "\n\n" + "=" * 40 + "\n\n"
    want = "T & co\n作者：Auth\n\nIntro" + rule + f"C0\n\np0\n\nq < 0{rule}C1\n\np1\n\nq < 1{rule}C2\n\n" + rule
    assert whole(pieces, "b", "book.txt") == want.strip() + "\n"
    assert whole(pieces, "e", "book.txt") == ("Empty" + rule).strip() + "\n"
    bare = X.export_txt(*export_tables(spark), include_header=False)
    assert whole(bare, "b", "book.txt").startswith("C0\n\np0")


def test_markdown_export(spark):
    pieces = X.export_markdown(*export_tables(spark))
    want = "# T & co\n\n- 作者：Auth\n- 来源：S\n\n> Intro\n## C0\n\np0\n\nq < 0\n## C1\n\np1\n\nq < 1\n## C2\n\n_（本章内容为空）_"
    assert whole(pieces, "b", "book.md") == want + "\n"
    assert whole(pieces, "e", "book.md") == "# Empty\n\n- 来源：S\n"


def test_ebook_parts(spark):
    import uuid
    import xml.dom.minidom

    books, chapters = export_tables(spark)
    covers = spark.createDataFrame([("b", ".png")], "book_id string, suffix string")
    parts = X.export_xhtml_parts(books, chapters, covers, {"rights": "{{author}}"})
    names = {(r["book_id"], r["part"]) for r in parts.select("book_id", "part").distinct().collect()}
    assert ("b", "OEBPS/chapter_0003.xhtml") in names and ("b", "OEBPS/cover.xhtml") in names and ("e", "OEBPS/cover.xhtml") not in names
    for book, part in names:
        if part.endswith((".xhtml", ".opf", ".ncx", ".xml")):
            xml.dom.minidom.parseString(whole(parts, book, part).encode())
    opf = whole(parts, "b", "OEBPS/content.opf")
    assert f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'book:b')}" in opf
    assert opf.index("<dc:title>") < opf.index("<dc:creator>") < opf.index("<dc:language>zh-CN") < opf.index("<dc:description>") < opf.index("<dc:publisher>P") < opf.index("<dc:rights>Auth") < opf.index("<dc:source>")
    assert "dcterms:modified\">1970-01-02T00:00:00Z" in opf
    assert opf.index('idref="cover"') < opf.index('idref="ch1"') < opf.index('idref="ch3"')
    assert "（无章节）" in whole(parts, "e", "OEBPS/toc.xhtml")


def test_written_pieces_concatenate_to_the_file(spark, tmp_path):
    import pathlib

    books, _ = export_tables(spark)
    chapters = spark.range(300).select(F.lit("b").alias("book_id"), F.col("id").alias("index"), F.concat(F.lit("C"), "id").alias("title"), F.lit("text\n\nmore").alias("content"))
    pieces = X.export_txt(books, chapters)
    S.write_pieces(pieces, str(tmp_path / "out"), tasks=6)
    files = sorted(pathlib.Path(tmp_path / "out" / "book_id=b" / "part=book.txt").glob("part-*"))
    assert len(files) > 1
    assert "".join(f.read_text() for f in files) == whole(pieces, "b", "book.txt")


def test_rule_files_with_broken_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"source_id":"s","capability":"book","field":"title","rule":"h1"}\n{"source_id":\n{"capability":"x"}\n')
    good, bad = S.read_rules(spark, str(tmp_path))
    assert [r["rule"] for r in good.cache().collect()] == ["h1"]
    assert bad.cache().count() == 2


def test_landed_responses_and_assets(spark, tmp_path):
    data = [("s", "u1", 200, {"a": "b"}, bytearray(b"x"), "utf-8", None), ("s", "u2", 500, {}, bytearray(b""), None, None)]
    spark.createDataFrame(data, S.RESPONSES).write.parquet(str(tmp_path / "r"))
    assert [r["url"] for r in S.read_responses(spark, str(tmp_path / "r")).collect()] == ["u1"]
    assert S.read_responses(spark, str(tmp_path / "r"), stream=True).isStreaming
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c.png").write_bytes(b"img")
    (tmp_path / "a" / "c.txt").write_bytes(b"no")
    assert [r["length"] for r in S.read_assets(spark, str(tmp_path / "a")).collect()] == [3]


def test_keyword_tables_like_the_keyword_list(spark):
    from pagemill.operators import keywords as KW

    bodies = ["The cat SAT on the mat", "", None, "catalogue of cats " * 30, "x", "été ÉTÉ cat", "aaa"]
    df = spark.createDataFrame([("b", f"c{i}", i, b) for i, b in enumerate(bodies)], "book_id string, id string, index int, content string")
    words = ["cat", "CAT", "the", "sat on", "été", "aa", "a", "missing", "cats ", " "]
    table = spark.createDataFrame([(w,) for w in [*words, "", None, "cat"]], "keyword string")
    want = sorted(map(tuple, L.search_many(df, words).select("book_id", "id", "index", "keyword", "snippet").collect()))
    for block in (KW.AUTOMATON_BYTES, 24):  # one automaton, and several passes
        assert sorted(map(tuple, KW.search_keywords(df, table, block_bytes=block).collect())) == want
    assert KW.search_keywords(df, table.limit(0)).count() == 0


def test_a_hundred_thousand_keywords_in_one_pass(spark):
    from pagemill.operators import keywords as KW

    table = spark.range(100_000).select(F.concat(F.lit("key"), F.col("id").cast("string"), F.lit("!")).alias("keyword"))
    df = spark.range(2_000).select(F.lit("b").alias("book_id"), F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("index"),
                                   F.concat(F.lit("text of key"), (F.col("id") * 37).cast("string"), F.lit("! and more")).alias("content"))
    found = KW.search_keywords(df, table)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = found.collect()
    assert {r.id: r.keyword for r in rows} == {str(i): f"key{37 * i}!" for i in range(2_000)} and len(rows) == 2_000


def test_packed_exports_are_few_files(spark, tmp_path):
    from pagemill.sources.tables import read_packed, write_packed

    rows = [(f"b{i % 40}", f"p{i % 2}", i, ("é\n" * (i % 7)) if i % 11 else None) for i in range(600)]
    pieces = spark.createDataFrame(rows, "book_id string, part string, ord int, content string").repartition(5)
    path = str(tmp_path / "packed")
    index = write_packed(pieces, f"file://{path}", tasks=3, file_bytes=1_000)
    files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
    assert len(files) <= 12 and not [f for f in os.listdir(path) if f.startswith("_part")]
    assert sorted(map(tuple, read_packed(index, f"file://{path}").collect())) == sorted((b, p, o, c or "") for b, p, o, c in rows)
    one = read_packed(index.filter("book_id = 'b7'"), f"file://{path}")
    assert {(r.part, r.ord) for r in one.collect()} == {(p, o) for b, p, o, _ in rows if b == "b7"}
    text = "".join(open(f"{path}/{f}", encoding="utf-8", newline="").read() for f in files)
    assert text == "".join(c or "" for _, _, _, c in sorted(rows, key=lambda r: r[:3]))
