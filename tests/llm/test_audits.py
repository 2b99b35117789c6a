"""Archives, source divergence and filter interaction on odd rows against plain versions."""

import gzip
import hashlib
import re
import uuid
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidepost.llm import divergence, interaction, warc
from tidepost.session import shared_folder


def new_folder(spark):
    return f"{shared_folder(spark)}/tidepost/test-{uuid.uuid4().hex}"


LONG = "<p>word " * 200
PAGES = [
    (1, "http://a", LONG, "x"),
    (2, "http://b", LONG, "x"),
    (2, "http://b", LONG, "x"),
    (None, None, LONG, "x"),
    (3, "http://c\r\nWARC-Type: revisit", "short", "x"),
    (4, "http://c", "short", "x"),
    (5, None, None, "x"),
    (6, "http://d", "", "x"),
    (7, "http://e", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" * 100 + "\r\n", "x"),
    (8, "http://f", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" * 100 + "\r\n", "x"),
    (9, "http://g", "\r\n" * 2000, "x"),
    (10, "http://h", "ü漢🙂" * 200_000, "x"),
]


def test_pages_come_back_from_the_archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_id string").repartition(3)
    found = Counter(map(tuple, warc.archived(pages).collect()))
    expected = Counter()
    for page_id, _, html, _ in PAGES:
        data = (html or "").encode()
        best = max((p for p, _, h, _ in PAGES if (h or "").encode() == data and p is not None), default=None)
        first = page_id == best and (page_id, "response") not in {(p, k) for p, _, _, k, _ in expected}
        again = len(data) >= 1000 and not first
        expected[(page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None)] += 1
    assert found == expected
    assert warc.archived(pages.limit(0)).count() == 0


def test_payloads_survive_and_a_second_pass_changes_nothing(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, record_id string")
    folder = new_folder(spark)
    warc.capture(pages, f"{folder}/one", date="2031-05-01T00:00:00Z")
    warc.deduplicate(spark, f"{folder}/one", f"{folder}/two")
    warc.deduplicate(spark, f"{folder}/two", f"{folder}/three")
    one, two, three = (sorted(map(tuple, warc.read(spark, f"{folder}/{n}").collect()), key=repr) for n in ("one", "two", "three"))
    assert two == three and len(one) == len(two) == len(PAGES)
    assert sorted(r[-1] for r in one) == sorted((h or "").encode() for _, _, h, _ in PAGES)
    assert Counter(r[-1] for r in two if r[1] == "response") == Counter({**Counter(r[-1] for r in one), LONG.encode(): 1, PAGES[8][2].encode(): 1})
    assert {r[3] for r in one} == {"2031-05-01T00:00:00Z"}


def record(kind, name, block, **fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]]
    return ("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = bytes(range(256)) * 8
    kind = "application/http; msgtype=response"
    records = [
        record("warcinfo", "info", b"software: x\r\n", Content_Type="application/warc-fields"),
        record("response", "old", http + body, Content_Type=kind, X_Page_Id=1, WARC_Target_URI="http://a"),
        record("revisit", "new", http, Content_Type=kind, X_Page_Id=5, WARC_Refers_To="<urn:old>", WARC_Target_URI="http://b"),
        record("revisit", "lost", http, Content_Type=kind, X_Page_Id=9, WARC_Refers_To="<urn:gone>", WARC_Payload_Digest="sha1:ABC"),
        record("resource", "file", b"plain", Content_Type="text/plain"),
    ]
    # One gzip member a record, as archives have it.
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    out = str(tmp_path / "out")
    warc.deduplicate(spark, str(tmp_path / "in"), out)
    found = {r.record_id: r for r in warc.read(spark, out).collect()}
    assert {k[5:-1]: r.kind for k, r in found.items()} == {"info": "warcinfo", "old": "revisit", "new": "response", "lost": "revisit", "file": "resource"}
    assert found["<urn:new>"].payload == body and found["<urn:new>"].uri == "http://b"
    assert found["<urn:old>"].refers_to == "<urn:new>" and found["<urn:lost>"].refers_to == "<urn:gone>"
    assert found["<urn:info>"].payload == b"software: x\r\n" and found["<urn:info>"].content == "application/warc-fields"
    rows = {r.page_id: r for r in warc.digest(warc.read(spark, out)).collect()}
    assert rows[1].payload_bytes == len(body) and rows[1].refers_to == 5
    assert rows[9].payload_bytes is None and rows[9].payload_digest == "ABC" and rows[9].refers_to is None


@pytest.mark.parametrize("data", [b"junk\r\n\r\n", record("response", "a", b"x" * 50)[:-20], b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"])
def test_broken_archives_fail(spark, tmp_path, data):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="record"):
        warc.read(spark, str(tmp_path)).collect()


def plain_divergence(rows, least, ranks):
    docs = [((lang or ""), (source or ""), [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        total = sum(counts.values(), Counter())

        def shares(c):
            return [1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept]

        def far(p, q):
            return (p - q) * (p - q) // (p + q)

        q = shares(total)
        for source in {d[1] for d in mine}:
            p = shares(counts[source])
            pairs = [(-sum(map(far, p, shares(counts[o]))), o.encode(), o) for o in {d[1] for d in mine} if o != source]
            terms = [(-far(a, b), t.encode(), t) for t, a, b in zip(kept, p, q, strict=True) if counts[source][t] and a > b]
            out += [(lang, source, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, source, "term", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 16, 100, 1 << 20])
def test_terms_of_long_texts(piece, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", piece * 16)
    text = "One  two,TWO three éÉ漢字 " * 50 + "x" * 300 + "9" + "Y" * 40
    plain = Counter(t.encode() for t in re.findall(r"[a-zA-Z\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)})))
    assert divergence.terms_of(text.encode()) == plain and divergence.terms_of(b"") == Counter()


@pytest.mark.parametrize(("tile", "terms"), [(256, 2048), (2, 3)])
def test_divergence_equals_plain_version(spark, monkeypatch, tile, terms):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    words = "alpha Beta GAMMA ärger été 漢字 naïve ÄRGER x1y don't".split()
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(i % 9)), ["en", "de", None][i % 3], [None, "a", "ä", "b", "z"][i % 5]) for i in range(90)]
    rows += [(i, "alpha", "en", "hot") for i in range(200, 260)] + [(7, None, "fr", "a"), (7, "one two", "fr", "b"), (None, "solo", "xx", "a")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, term string").repartition(4)
    found = sorted(map(tuple, divergence.audit(docs, least_documents=3, ranks=4).collect()))
    assert found == plain_divergence(rows, 3, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    rows = [(9_000_000_000_000_000, 9_100_000_000_000_001, 12_345_678_901), (0, 3, 1), (10**10, 10**10 + 7, 5)]
    found = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.part_of(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r.p for r in found.collect()] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]


def plain_interaction(rows, labels):
    rows = [(i, t or "", s or "") for i, t, s in rows]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = []
    masks = defaultdict(list)
    for i, t, s in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(o == t and j is not None and j < i for j, o, _ in rows),
        }
        masks[s].append((i, {k for k, v in fails.items() if v}))
    for part, docs in masks.items():
        worth = Counter()
        made = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                worth[f] += len(gone)
                hit = sum(f in m for _, m in docs)
                alone = sum(m == {f} for _, m in docs)
                made.append((part, order, k + 1, f, len(left), len(gone), hit - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*m, worth[m[3]]) for m in made]
    return sorted(out)


def test_interaction_equals_plain_version(spark):
    base = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t", "Short", base, base + " #", base.upper(), "same " * 300, "A & B " * 150, "é" * 10]
    rows = [(i, texts[(i * i) % len(texts)], ["a", None, "", "b"][i % 4]) for i in range(60)]
    rows += [(i, base, "hot") for i in range(100, 160)] + [(3, base, "a"), (3, base, "a"), (None, base, "b"), (None, "", None)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 130)] + [(4, None, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, mask int").repartition(4)
    found = interaction.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, found.collect())) == plain_interaction(rows, labels)
    assert interaction.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
