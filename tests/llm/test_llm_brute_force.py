"""The operators against plain Python, and their edge cases: nulls, repeats, ties, long texts, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import bpe, exact_dedup, html, line_dedup, media, minhash, mixing, secrets, substrings, toxicity

TEXT = "doc_id long, text string"
#: Names that the operators use themselves, as columns of the user's.
CLASH = "doc_id long, text string, d string, t string, row string, drops string, cuts string, copies string, copy string, th string, `a.b` string"
ODD = [(1, "one two three four five six"), (1, "another text of the same id"), (2, None), (3, ""), (None, "no id at all here"), (None, "no id at all here"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "long " * 20_000)]


def clashing(spark, rows=ODD):
    return spark.createDataFrame([(*row, *"qrstuvwxy") for row in rows], CLASH)


def labels(spark, rows=((1, 0), (3, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


# Line dedup


def kept_lines(docs, depth=5, least=4, similar=0.7):
    """(id, text) with the lines of recurring templates dropped, by ranking every line's tokens as the docstring says."""
    split = [(i, text.split("\n")) for i, text in docs]
    masked = lambda line: [re.sub(r"\S*[0-9]\S*", "<*>", t) for t in line.split(" ")]
    distinct = {line for _, lines in split for line in lines if len(line.split(" ")) >= least}
    count = {}
    for line in distinct:
        tokens = masked(line)
        for p, tok in enumerate(tokens):
            key = (len(tokens), *tokens[:depth]), p, tok
            count[key] = count.get(key, 0) + 1

    def template(line):
        if line not in distinct:
            return line
        tokens = masked(line)
        leaf = (len(tokens), *tokens[:depth])
        more = max(math.ceil(similar * len(tokens) - 1e-9) - depth, 0)
        best = sorted(range(depth, len(tokens)), key=lambda p: (-count[leaf, p, tokens[p]], p))[:more]
        return leaf, tuple((p, tokens[p]) for p in sorted(best))

    places = {}
    for i, lines in sorted(split):
        for k, line in enumerate(lines):
            if line in distinct or line.strip():
                places.setdefault(template(line), []).append((i, k))
    gone = {place for own in places.values() if len({i for i, _ in own}) > 1 for place in own[1:]}
    return {i: "\n".join(line for k, line in enumerate(lines) if (i, k) not in gone) for i, lines in split}


def test_line_dedup_has_several_templates_a_leaf(spark):
    tie = ["p q r s t aa bb cc dd mon", "p q r s t aa bb cc dd tue", "p q r s t zz yy xx ww wed", "p q r s t zz yy xx ww thu"]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(tie)), TEXT)).collect()}
    assert got == {0: tie[0], 1: "", 2: tie[2], 3: ""}
    path = "one two three four five "
    many = [path + "alpha beta gamma delta w%s" % "abcd"[i] for i in range(4)] + [path + "eins zwei drei vier w%s" % "efg"[i] for i in range(3)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(many)), TEXT)).collect()}
    assert [i for i in range(7) if got[i]] == [0, 4]


def test_line_dedup_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "17", "x9", ""]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 5, 7, 8, 9, 12))))
    pool = ["in the year of our lord " + " ".join(rng.choice("klmn") for _ in range(4)) + " " + str(rng.random()) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice((line(), rng.choice(pool), "in the year of our lord k l m n word" + rng.choice("uvw"))) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, TEXT).repartition(3)).collect()}
    assert got == kept_lines(docs)


# Toxicity


def test_automaton_against_edit_distance():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    terms = sorted({word() for _ in range(60)})
    trie = toxicity.Trie(terms)
    for most in (1, 2):
        for token in (word() for _ in range(300)):
            near = [(e, t) for t in terms if (e := distance(token, t)) <= min(most, toxicity.reach(t))]
            assert trie.near(token, most) == min(near, default=None)


# Mixing


def test_fit_against_least_squares(spark):
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 400, 60).astype(float), rng.dirichlet([0.3] * 3, 60)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    goal = (n @ p) * [1.4, 0.7, 1.0]
    done, wanted, reached = mixing.fit(members, 3, list(goal), 0.0, 1.0)
    rows = done.collect()
    rate = np.array([r.rate for r in rows])
    totals = np.array([[r.n_tokens * r[f"p{j}"] for j in range(3)] for r in rows]).T @ rate
    assert rate.min() >= 0 and np.allclose(totals, wanted, rtol=1e-4) and np.allclose(reached, totals)
    # Dense least squares by the same projection, one step of curvature bound after another, ends where it does.
    r, s = np.ones(60), n @ p
    for _ in range(5000):
        r = np.maximum(0, r - p @ ((n * r @ p - wanted) / s))
    assert np.allclose(n * r @ p, totals, rtol=1e-3)


def test_hits_count_every_word(spark):
    texts = ["the the\nthe", "The, the", "", "of the.", "x" * 1000 + " the"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing._hits(["the", "th", "of"], "text").alias("h")).collect()
    assert [r.h for r in rows] == [[w for w in t.split() if w in ("the", "th", "of")] for t in texts]


# Secrets


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["password", "Secret", "api_key", "TOKEN", "=", ": ", ' "', "abcdefgh12", "AKIA" + "Q" * 16, "AKIAX", "0123456789abcdef" * 2, "deadbeef", " ", "é", "https://ann:" + "p" * 300 + "@host", "Bearer " + "t" * 25, "-----BEGIN RSA PRIVATE KEY-----", "\n"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(150)] + [(150, None)]
    plain = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))
    table = spark.createDataFrame(docs, TEXT).repartition(3)
    base = [rule for rule in secrets.RULES if rule.kind in secrets.BASE]
    first, ledger = secrets.scan_blobs(table, rules=base)
    found, new = secrets.scan_blobs(table, ledger)
    once = {r.doc_id: r for r in secrets.digest(secrets.scan_blobs(table)[0]).collect()}
    for r in secrets.digest(found).collect():
        text = dict(docs)[r.doc_id] or ""
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(plain) for m in re.compile(p, re.ASCII).finditer(text) if len(m[g]) >= least)
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert r.n_hex == sum(s.startswith("hex") for *_, s in spans) and r.spans == once[r.doc_id].spans
        assert ("url:" in r.spans) == bool(re.search(r"[a-z]://ann:p{300}@", text))
    assert {tuple(r.rule_versions) for r in new.collect()} == {tuple(rule.version for rule in secrets.RULES if rule not in base)}
    again, none = secrets.scan_blobs(table, ledger.unionByName(new))
    assert none.count() == 0 and {r.doc_id: r.spans for r in secrets.digest(again).collect()} == {i: r.spans for i, r in once.items()}


def test_own_rules_of_known_names():
    assert secrets.find("hex:zz", [secrets.Rule("hex", "z+")]) == [("hex", 4, 6)]


# HTML


def test_marginals_against_all_states():
    rng = random.Random(3)
    for _ in range(20):
        nodes = [html.Node("div", None)]
        for _ in range(rng.randint(1, 7)):
            nodes.append(html.Node(rng.choice(("p", "nav", "section")), rng.choice(nodes)))
            nodes[-1].chars = rng.choice((0, 10, 100))
        weights, coupling = [rng.uniform(-1, 1) for _ in html.NAMES], rng.uniform(0, 1)
        field = [0.5 * sum(weights[i] for i in row) for row in html.features(nodes)]
        total, on = 0.0, [0.0] * len(nodes)
        for state in itertools.product((-1, 1), repeat=len(nodes)):
            weight = math.exp(sum(f * s for f, s in zip(field, state, strict=True)) + coupling * sum(state[i] * state[nodes.index(n.parent)] for i, n in enumerate(nodes) if n.parent))
            total += weight
            on = [o + weight * (s > 0) for o, s in zip(on, state, strict=True)]
        assert html.marginals(nodes, weights, coupling) == pytest.approx([o / total for o in on], abs=1e-9)


#: Pages of layouts that the generator does not make, with their text as a reader would copy it.
FOREIGN = [
    (
        "<html><body><table><tr><td><div id=nav><a href=/a>Start</a> <a href=/b>Archive</a></div></td></tr></table><div role=main><h2>On rivers</h2><p>Rivers run, as a rule, downhill. Some take their time.</p><p>Others, however, do not, and <em>that</em> is well known.</p></div><div class='footer-wrap'><p>Copyright 2020, all rights reserved</p></div></body></html>",
        ["On rivers", "Rivers run, as a rule, downhill. Some take their time.", "Others, however, do not, and that is well known."],
    ),
    (
        "<body><div class='site-header'><ul><li><a href=/>Home</a></li></ul></div><section class='post'><header><h1>Bread</h1></header><p>Flour, water, salt and time make bread; nothing else is needed, they say.</p><ol><li>Mix the flour, and wait.</li><li>Bake it, and wait again.</li></ol></section><div id='comments'><p>Great post, thanks for sharing it with us all.</p></div></body>",
        ["Flour, water, salt and time make bread; nothing else is needed, they say.", "Mix the flour, and wait.", "Bake it, and wait again."],
    ),
]


def test_html_of_foreign_layouts(spark):
    pages = spark.createDataFrame([(i, None, page) for i, (page, _) in enumerate(FOREIGN)] + [(8, "u", None), (8, "u", None), (None, "v", "")], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in html.extract(pages).collect()}
    for i, (_, blocks) in enumerate(FOREIGN):
        assert [b for b in got[i, None].text.split("\n\n") if b != "Bread"] == blocks and got[i, None].n_chars == len(got[i, None].text)
    assert got[8, "u"].text == "" and got[None, "v"].n_chars == 0 and html.extract(pages).count() == 5
    assert html.extract(pages.limit(0)).count() == 0


# Media


def test_area_means_by_looping():
    rng = np.random.default_rng(4)
    for height, width, h, w in ((7, 5, 3, 2), (40, 9, 8, 9), (2100, 4, 5, 3), (3, 3, 8, 9)):
        image = rng.integers(0, 256, (height, width)).astype(np.uint8)
        out = np.zeros((h, w))
        cover = lambda a, b, size: [(i, min(b, i + 1) - max(a, i)) for i in range(size) if min(b, i + 1) > max(a, i)]
        for y, x in itertools.product(range(h), range(w)):
            rows, columns = cover(y * height / h, (y + 1) * height / h, height), cover(x * width / w, (x + 1) * width / w, width)
            out[y, x] = sum(image[i, j] * a * b for i, a in rows for j, b in columns) * h * w / height / width
        assert np.allclose(media.area_resize(image, h, w), out)


def test_media_digests(spark):
    texts = [None, "", "é" * 288, "x" * 577, "y" * 50_000, "y" * 50_000]
    for r in media.media_columns(spark.createDataFrame(list(enumerate(texts)), TEXT)).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.decode_image(bytes(r.media)).tobytes() == payload and (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert np.load(__import__("io").BytesIO(bytes(r.tile_npy))).shape == (32, 32)


def test_media_formats():
    assert media.decode_image(b"P1\n# c\n3 2\n101\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_image(b"P4\n10 1\n\xa0\x40").tolist() == [[0, 255, 0, 255, 255, 255, 255, 255, 255, 0]]
    assert media.decode_image(b"P2 2 1 15 0 15").tolist() == [[0, 255]] and media.decode_image(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"GIF89a", b"P7 1 1 1 x", b"P2 2 1 15 0"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


# Edge cases of all


def test_empty_tables(spark):
    none, page = spark.createDataFrame([], CLASH), spark.createDataFrame([], "page_id long, url string, html string")
    assert toxicity.toxicity(none, labels(spark)).count() == html.extract(page).count() == 0
    assert mixing.mixed(none, none.selectExpr("text AS domain", "text")).count() == mixing.mix(none, none.selectExpr("text AS domain", "text")).count() == 0


def test_odd_rows(spark):
    docs = clashing(spark)
    for f in (exact_dedup.exact_dedup, substrings.suffix_dedup, minhash.near_duplicates, media.media_columns, bpe.bpe, lambda d: secrets.scan_blobs(d)[0], lambda d: toxicity.toxicity(d, labels(spark))):
        assert f(docs).count() == len(ODD)
    table = spark.createDataFrame([("en", "one two three"), ("fr", "un deux trois")], "domain string, text string")
    for found in (line_dedup.line_dedup(docs), mixing.mixed(docs, table)):
        rows = found.collect()
        assert found.columns[: len(docs.columns)] == docs.columns and {r["a.b"] for r in rows} == {"y"} and {r.drops for r in rows} == {"t"}
        assert len(rows) >= len(ODD)
    assert len({(r.score, r.predicted) for r in toxicity.toxicity(docs, labels(spark)).where("doc_id = 4").collect()}) == 1


def test_near_copies_of_one_id(spark):
    docs = clashing(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (None, "k l m n o p"), (None, "k l m n o p"), (3, None), (4, "")])
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.where("text is not null").collect()) == [(0, "k l m n o p"), (1, "a b c d e f"), (2, "q r s t u v")]
    assert got.where("doc_id in (3, 4)").count() == 1


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join("w%s" % rng.choice("abcdefghijklmnop") + "xyz"[k % 3] for k in range(n))
    docs = [(i, ("vermin scumbag " * 3 if i % 10 == 0 else "") + words(40) + "\nAll of these rights are reserved by us\n" + words(9), "en", 0) for i in range(120)]
    docs += [(200 + i, docs[i + 1][1], "en", 0) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        kept.append(now.collect())
    assert {r.doc_id for r in kept[0]} == {i for i, text, *_ in docs if "vermin" not in text}
    plain = kept_lines([(r.doc_id, r.text) for r in kept[0]])
    assert {r.doc_id: r.text for r in kept[1]} == {i: t for i, t in plain.items() if t.strip()} and all(r.n_chars == len(r.text) for r in kept[1])
    assert {r.doc_id for r in kept[2]} <= {r.doc_id for r in kept[1]} and {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2]}
    assert len(kept[4]) == len(kept[3]) and sum(r.n_tokens for r in kept[4]) == sum(len(r.ids) for r in kept[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
