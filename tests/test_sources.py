import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions import text as tx
from itemloom.operators import outline, projection, quality
from itemloom.sources import outlines, pages, shards, sinks


def record(n, cert="mini-a", provider="udemy", **over):
    base = {
        "id": f"{cert}/exam-01/q{n:03d}", "content_hash": f"h{n}",
        "certification": {"slug": cert, "name": cert.upper(), "vendor": "v", "level": None},
        "exam": {"slug": "exam-01", "title": "Exam 1", "number": 1, "mode": None, "question_number": n},
        "domain": "Prompt & Context", "type": "single_select", "select_count": 1, "prompt_md": f"Question {n}?",
        "options": [{"label": x, "text_md": f"opt {x}", "correct": x == "B", "explanation_md": f"why {x}"} for x in "ABCD"],
        "correct_labels": ["B"], "overall_explanation_md": "Because.", "references": ["https://a.org/x", "https://a.org/x/"],
        "source": {"provider": provider, "course_url": "u", "file": "f"},
    }
    return {**base, **over}


@pytest.fixture()
def kb(tmp_path):
    root = tmp_path / "kb"
    (root / "questions").mkdir(parents=True)
    dump = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (root / "questions.jsonl").write_text(dump([record(1), record(2)]))
    (root / "questions" / "gen.jsonl").write_text(dump([record(3, "mini-b", "local_generation", origin="curated")]))
    (root / "annotations.jsonl").write_text("{}\n")
    return root


def test_shards(spark, kb):
    found = shards.discover_shards(spark, str(kb)).orderBy("rank", "path").collect()
    assert [r["path"] for r in found] == ["questions.jsonl", "questions/gen.jsonl"]
    rows = shards.scan_questions(spark, str(kb))
    assert rows.count() == 3
    assert shards.scan_questions(spark, str(kb), "local_generation").count() == 1
    index = {r["path"]: r for r in shards.build_index(spark, str(kb)).collect()}
    digest = hashlib.sha256((kb / "questions.jsonl").read_bytes()).hexdigest()
    assert tuple(index["questions.jsonl"]) == ("questions.jsonl", "udemy", 2, digest)
    assert rows.orderBy("order_key").first()["id"] == "mini-a/exam-01/q001"


def test_projection_of_a_scan(spark, kb):
    rows = shards.scan_questions(spark, str(kb))
    q = {r["id"]: r for r in projection.question_rows(rows).collect()}
    assert q["mini-a/exam-01/q001"]["domain_id"] == "mini-a/prompt-and-context"
    assert q["mini-a/exam-01/q001"]["origin"] == "vendor_dump" and q["mini-b/exam-01/q003"]["origin"] == "curated"
    assert q["mini-a/exam-01/q001"]["prompt_sha256"] == hashlib.sha256(b"Question 1?").hexdigest()
    cited = projection.citations(rows)
    assert {(r["id"], r["question_count"]) for r in projection.reference_rows(cited).collect()} == {("a.org/x", 3)}
    assert quality.corpus_problems(rows).isEmpty()


def test_sinks(spark, kb, tmp_path):
    rows = shards.scan_questions(spark, str(kb)).drop("order_key", "shard_path")
    sinks.write_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    sinks.write_study(rows, str(tmp_path / "study"))
    folder = next((tmp_path / "study").glob("certification_id=mini-a/*"))
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text.index("### mini-a/exam-01/q001") < text.index("### mini-a/exam-01/q002")
    assert "**✅ B. opt B**" in text and "> why A" in text and "- <https://a.org/x>" in text
    base = str(tmp_path / "tables" / "question")
    sinks.publish_version(rows, base, "r1")
    sinks.publish_version(rows.limit(1), base, "r2")
    assert sinks.read_current(spark, base).count() == 1
    with pytest.raises(ValueError, match="r2 is published"):
        sinks.publish_version(rows, base, "r2")


def test_publishing_writes_only_changes(spark, tmp_path):
    base = str(tmp_path / "docs")
    assert sinks.read_current(spark, base) is None
    first = spark.createDataFrame([(i, f"t{i}", None) for i in range(50)], "id bigint, text string, note string")
    assert sinks.publish_changes(first, base, "r1", ["id"])
    reader = sinks.read_current(spark, base)  # opened before the next publish
    assert sinks.publish_changes(first.repartition(3), base, "r2", ["id"]) is None
    second = first.where("id > 0").withColumn("note", F.when(F.col("id") == 7, "new"))
    # What an attempt that broke off has left is no version.
    second.limit(2).write.parquet(f"{base}/run_id=r3/broken")
    assert reader.count() == 50 and sinks.read_current(spark, base).count() == 50
    assert sinks.publish_changes(second, base, "r3", ["id"])
    assert reader.count() == 50 and reader.where("note is not null").isEmpty()
    now = sinks.read_current(spark, base)
    assert now.count() == 49 and {r["ingest_run_id"] for r in now.collect()} == {"r3"}
    assert [(r["run_id"], r["rows"]) for r in sinks.versions(spark, base).orderBy("seq").collect()] == [("r1", 50), ("r3", 49)]
    with pytest.raises(ValueError, match="repeat"):
        sinks.publish_changes(second.union(second), base, "r4", ["id"])


def test_tidy():
    assert pages.tidy(" a \t\xa0b  \n \n\t\n\n c\n d \n\n") == "a b\n\nc\nd"
    assert pages.tidy("\n \n") == "" and pages.tidy("x") == "x"


OUTLINE = """# comment
certification: saa
vendor: v
regime: exact
levels: Domain, Task
source: g.pdf sha256=%s note=two words

- [60%%] One, & only
  - First
  - Second
- [40%%] Two
  - Third
""" % ("a" * 64)


def test_outline_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "saa.blueprint").write_text(OUTLINE)
    (tmp_path / "v" / "bad.blueprint").write_text("vendor: v\nregime: range\n- [9-5%] A\n      - deep\nlate: x\n- B\n")
    lines = outlines.classify_lines(outlines.read_outlines(spark, str(tmp_path)))
    nodes = outline.with_kinds(outline.flatten(lines), lines).where(F.col("file").endswith("saa.blueprint")).orderBy("line_no").collect()
    assert [(r["path"], r["parent_path"], r["label"], r["kind"], r["weight_pct"]) for r in nodes] == [
        ("1", None, "One, & only", "Domain", 60.0), ("1.1", "1", "First", "Task", None), ("1.2", "1", "Second", "Task", None),
        ("2", None, "Two", "Domain", 40.0), ("2.1", "2", "Third", "Task", None),
    ]
    sums = {r["regime"]: r for r in outline.weight_summary(outline.flatten(lines), outline.regimes(lines)).collect()}
    assert sums["exact"]["weights_sum_to_100"] is True and sums["range"]["weights_sum_to_100"] is None
    problems = outline.outline_problems(lines).collect()
    assert {r["file"].rsplit("/", 1)[-1] for r in problems} == {"bad.blueprint"}
    assert {(r["line_no"], r["problem"]) for r in problems} == {
        (1, "missing header: certification"), (3, "range runs backwards"), (4, "no parent"), (5, "expected a bullet"), (6, "weight missing for the regime"),
    }


def test_flatten_across_blocks(spark, monkeypatch):
    rows = [("f", i + 1, "  " * (i % 3) + f"- n{i}") for i in range(60)]
    lines = outlines.classify_lines(spark.createDataFrame(rows, "file string, line_no bigint, raw string"))
    whole = [r["path"] for r in outline.flatten(lines).orderBy("line_no").collect()]
    monkeypatch.setattr(outline, "BLOCK_LINES", 7)
    assert [r["path"] for r in outline.flatten(lines).orderBy("line_no").collect()] == whole
    assert whole[:4] == ["1", "1.1", "1.1.1", "2"] and whole[-1] == "20.1.1"


def outline_by_hand(depths):
    """Ordinal paths from the definition: the parent is the nearest earlier shallower line."""
    parents = [max((j for j in range(i) if depths[j] < d), default=None) for i, d in enumerate(depths)]
    ordinals = [sum(parents[j] == p for j in range(i + 1)) for i, p in enumerate(parents)]
    path = lambda i: (path(parents[i]) + "." if parents[i] is not None else "") + str(ordinals[i])
    return [(path(i), path(p) if p is not None else None) for i, p in enumerate(parents)]


def test_outlines_of_any_depth(spark, monkeypatch):
    deal = random.Random(5)
    files = {"deep": [1, 2, 3, 4, 5, 6, 2, 6, 9, 1, 40, 7, 3], "up": [9, 8, 7, 7, 3, 2, 1, 1]}
    files |= {f"r{n}": [deal.randint(1, 7) for _ in range(60)] for n in range(3)}
    rows = [(f, i + 1, "  " * (d - 1) + f"- n{i}") for f, ds in files.items() for i, d in enumerate(ds)]
    lines = outlines.classify_lines(spark.createDataFrame(rows, "file string, line_no bigint, raw string"))
    for block in (65536, 5, 1):
        monkeypatch.setattr(outline, "BLOCK_LINES", block)
        got = {f: [] for f in files}
        for r in outline.flatten(lines).orderBy("file", "line_no").collect():
            got[r["file"]].append((r["path"], r["parent_path"]))
        assert got == {f: outline_by_hand(ds) for f, ds in files.items()}
    refused = {(r["line_no"], r["problem"]) for r in outline.refused_lines(lines).where("file = 'deep'").collect()}
    assert refused == {(n, "deeper than 4") for n in (5, 6, 8, 9, 11, 12)} | {(n, "no parent") for n in (8, 9, 11)}



def test_blueprint_json(spark, tmp_path):
    folder = tmp_path / "blueprints" / "v"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text(json.dumps({"id": "v/c/1", "certification": "c", "vendor": "v", "weight_regime": "exact", "max_depth": 2,
        "nodes": [{"path": "1", "depth": 1, "ordinal": 1, "label": "D", "weight_pct": 100.0}, {"path": "1.2", "depth": 2, "ordinal": 2, "label": "T"}]}, indent=1))
    b = shards.scan_blueprints(spark, str(tmp_path))
    nodes = {r["id"]: r["parent_id"] for r in projection.blueprint_node_rows(b).collect()}
    assert nodes == {"v/c/1#1": None, "v/c/1#1.2": "v/c/1#1"}
    none = spark.createDataFrame([], "id string, name string, vendor string, level string, question_count bigint")
    assert projection.with_blueprint_certifications(none, b).first()["id"] == "c"


def test_plain_pages_round_trip(spark):
    good = '<html><script>var t="</p>";</script><article><h1>Ti_tle</h1><p><b>Bo*ld</b> a&amp;b<br><a href="/x">link</a> x[1] <code>c*d</code></p></article></html>'
    df = spark.createDataFrame(
        [(1, "u1", good), (2, "u2", "<p>no article</p>"), (3, "u3", "<article><video>v</video></article>")],
        "page_id bigint, url string, html string",
    )
    out = pages.extract_pages(df)
    rows = {r["page_id"]: r for r in out.collect()}
    assert rows[1]["title"] == "Ti_tle" and rows[1]["links"] == ["/x"]
    assert rows[1]["body_md"] == "Ti_tle\n\n**Bo\\*ld** a&b\n[link](/x) x\\[1\\] `c*d`"
    assert {r["page_id"]: r["problem"] for r in pages.quarantine(out).withColumnRenamed("url", "u").collect()} == {
        2: "expected 1 <article>, found 0", 3: "unexpected tag <video> in rich text",
    }
    linked = out.where("page_id = 1").withColumn("body_md", F.replace("body_md", F.lit("(/x)"), F.lit("(https://e.org/x)")))
    check = pages.lossless_check(linked, tx.strip_markdown(F.col("body_md"))).first()
    assert (check["compared"], check["mismatches"]) == (1, 0)


def test_shard_paths_with_blanks_and_nested_roots(spark, tmp_path):
    root = tmp_path / "kb" / "x" / "kb"
    (root / "questions").mkdir(parents=True)
    line = '{"id": "a/b/q1", "content_hash": "0", "source": {"provider": "udemy"}}\n'
    (root / "questions.jsonl").write_text(line)
    (root / "questions" / "a b+c.jsonl").write_text(line * 2)
    found = {r["path"]: r["rank"] for r in shards.discover_shards(spark, str(root)).collect()}
    assert found == {"questions.jsonl": 0, "questions/a b+c.jsonl": 1}
    rows = {r["path"]: (r["provider"], r["line_count"]) for r in shards.build_index(spark, str(root)).collect()}
    assert rows == {"questions.jsonl": ("udemy", 1), "questions/a b+c.jsonl": ("udemy", 2)}


def test_fingerprint_has_one_definition(spark):
    for n in (1, 999, 1001):
        files = [(i % 2, f"p/{i}", f"{i:064x}") for i in range(n)]
        buckets = {}
        for kind, path, sha in sorted(files):
            buckets.setdefault(hashlib.md5(path.encode()).hexdigest()[:3], []).append(f"{path}:{sha}\n")
        lines = "".join(f"{b}:{hashlib.sha256(''.join(rows).encode()).hexdigest()}\n" for b, rows in sorted(buckets.items()))
        got = shards.fingerprint(spark.createDataFrame(files, "kind int, path string, sha256 string")).first()["fingerprint"]
        assert got == hashlib.sha256(lines.encode()).hexdigest()
    changed = files[:7] + [(1, files[7][1], "zz")] + files[8:]
    assert shards.fingerprint(spark.createDataFrame(changed, "kind int, path string, sha256 string")).first()["fingerprint"] != got
