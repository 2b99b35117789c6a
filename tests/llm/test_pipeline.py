"""The corpus pipeline's stages on copy groups and empty texts."""

import hashlib
import re
import uuid
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidepost.llm import jaccard, mixing, queries
from tidepost.session import shared_folder

tokenizers = pytest.importorskip("tokenizers")


def test_one_copy_of_a_large_group_stays_with_its_text(spark, make):
    own = [(i, f"Site line\nfirst words of {i}\nsecond words of {i}", "h", "") for i in range(100)]
    copies = [(1000 + i, "Site line\ncopied words one\nand copied words two", "h", "") for i in range(50)]
    bare = [(2000 + i, "Site line", "h", "") for i in range(20)]
    cleaned = corpus_pipeline.drop_boilerplate(spark, make(own + copies + bare), "")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_near_copies(spark, cleaned, "").collect()}
    assert kept == {**{i: f"first words of {i}\nsecond words of {i}" for i in range(100)}, 1000: "copied words one\nand copied words two", 2000: ""}


def test_one_of_equal_texts_without_words_stays(make):
    rows = [(5, "", "a", "x"), (3, "", "a", "y"), (3, "", "a", "y"), (9, " ", "a", "z"), (None, "", "a", "z"), (1, "some words", "a", "z")]
    kept = jaccard.keep_one(make(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "some words"), (3, ""), (9, " ")]


def test_a_score_column_of_the_documents_is_left_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("quality_score", queries.F.lit("own"))
    plain = corpus_pipeline.keep_good(spark, docs.drop("quality_score"), folder)
    found = corpus_pipeline.keep_good(spark, docs, folder)
    assert found.columns == docs.columns and {r.quality_score for r in found.collect()} == {"own"}
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in plain.collect())


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def written(spark, frame):
    path = f"{shared_folder(spark)}/tidepost/test-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_plain_versions(spark, tmp_path):
    """All stages in turn over a small table with copies, near copies, a hot source, site lines, empty and null texts."""
    words = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(400)]
    fresh = lambda n: " ".join(words.choice(vocabulary, n))
    rows = [(i, f"Site line\n{fresh(60)}", "hot" if i % 3 else "small", "en") for i in range(90)]
    copied = fresh(80)
    rows += [(200 + i, copied, "hot", "en") for i in range(40)]
    rows += [(300, copied.replace("word1 ", "word2 ") + " tail", "small", "en"), (301, copied + " more", None, "en")]
    rows += [(400, None, "hot", None), (401, "", "hot", "en"), (402, "", "small", "en"), (403, " \n", None, "en"), (403, " \n", None, "en"), (None, fresh(50), "hot", "en")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = str(tmp_path)
    names = [name for name, _ in corpus_pipeline.STAGES]
    stages = dict(zip(("good", "lines", "near", "mixed", "encoded"), (f for _, f in corpus_pipeline.STAGES), strict=True))
    assert len(names) == 5
    # Without a label every score is a half: all go. So the later stages start from the table itself.
    assert stages["good"](spark, docs, folder).count() == 0
    assert stages["good"](spark, docs, folder).schema.names == docs.columns
    cleaned = written(spark, stages["lines"](spark, docs, folder))
    hosts = {}
    for _, text, source, _ in rows:
        hosts.setdefault(source, set()).add(text or "")
    expected = []
    for doc_id, text, source, lang in rows:
        common = Counter(x for t in hosts[source] for x in {line.strip(" \t\n\v\f\r") for line in t.split("\n")} - {""})
        bad = {x for x, n in common.items() if n >= 3 and n / len(hosts[source]) > 0.05}
        kept = None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\n\v\f\r") not in bad)
        expected.append((doc_id, kept, source, lang, None if kept is None else len(kept)))
    assert Counter(map(tuple, cleaned.collect())) == Counter(expected)
    near = written(spark, stages["near"](spark, cleaned, folder))
    groups, seen = [], {}
    for row in expected:
        mine = grams(row[1])
        same = [g for g in groups if any((mine and len(mine & o) / len(mine | o) >= 0.8) or (not mine and not o and t == row[1]) for o, t in g["sets"])]
        made = {"rows": [row], "sets": [(mine, row[1])]}
        for g in same:
            made["rows"] += g["rows"]
            made["sets"] += g["sets"]
        groups = [g for g in groups if all(g is not x for x in same)] + [made]
    best = [min(g["rows"], key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    assert Counter(r.doc_id for r in near.collect()) == Counter(r[0] for r in best)
    mixed = written(spark, stages["mixed"](spark, near, folder))
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) == {r[0] for r in best} and set(times.values()) <= {1, 2}
    tokens = Counter()
    for r in mixed.collect():
        tokens[r.source] += len((r.text or "").split())
    once = Counter()
    for r in best:
        once[r[2]] += len((r[1] or "").split())
    most, least = max(once.values()), min(v for v in once.values() if v)
    for source, n in once.items():
        if n:
            # The smallest source is read 1.5 times as often as the largest, the others in between.
            share = (n / most) ** (np.log(least * 1.5 / most) / np.log(least / most)) * most
            assert abs(tokens[source] - share) <= 80
    found = Counter(map(tuple, stages["encoded"](spark, mixed, folder).collect()))
    plain = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    wanted = Counter()
    for r in mixed.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        wanted[(r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert found == wanted


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, folder))
        assert docs.count() == 0


def test_run_gives_what_its_stages_give(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, folder))
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


def test_mixture_query_is_the_mixture(spark, folder):
    """The query's rows by a plain version: passes, budgets and blocks."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = queries.op8_mixture(spark, folder).collect()
    tokens = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    totals = Counter()
    for r in docs:
        totals[r.source] += tokens[r.doc_id]
    most, least = max(totals.values()), min(v for v in totals.values() if v)
    power = mixing.bisect_repetition(least, most, 1.5)
    assert abs((most / least) ** (1 - power) - 1.5) < 1e-6 or power in (0, 1)
    read = Counter()
    for r in found:
        assert r.tokens == tokens[r.doc_id]
        read[r.source] += r.tokens
    longest = max(tokens.values())
    for source, total in totals.items():
        budget = total * (most / total) ** (1 - power)
        assert budget - longest <= read[source] <= budget + 1
    epochs = Counter((r.source, r.epoch) for r in found)
    for source, n in Counter(r.source for r in docs).items():
        assert epochs[(source, 0)] == n and epochs[(source, 1)] < n
    slots = {}
    for r in found:
        slots.setdefault(r.block, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
