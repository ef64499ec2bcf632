"""Brute force, round trips and edge cases on small frames."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import bpe, exact_dedup, html, line_dedup, media, minhash, mixing, secrets, substrings, toxicity

TEXT = "doc_id long, text string, n long"


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], TEXT).repartition(parts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXT)
    for f in (exact_dedup.exact_dedup, substrings.suffix_dedup, minhash.near_duplicates, line_dedup.line_dedup, media.media_columns, bpe.bpe, lambda d: secrets.scan_blobs(d)[0]):
        assert f(none).count() == 0


def test_exact_dedup(spark):
    texts = ["a b", "ab", " a  b ", None, "", " \n", "c", "x" * 50_000] + ["hot copy"] * 60
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert [got[i].keep_id for i in range(8)] == [2, 2, 2, 5, 5, 5, 6, 7] and got[10].group_size == 60 and got[8].kept and not got[9].kept
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    assert (exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)) == values).all()


@pytest.mark.parametrize("options", [{}, {"hot_tasks": 1}, {"most_in_task": 2}, {"filter_bits": 9}])
def test_suffix_dedup(spark, options):
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcdefghij é") for _ in range(260)) for _ in range(3)]
    texts = [None, "", "ab" * 300] + ["".join(rng.choice((rng.choice(shared)[rng.randrange(90) :], "".join(rng.choice("xyz ") for _ in range(60)))) for _ in range(4)) for _ in range(25)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.suffix_dedup(frame(spark, texts), **options).collect()}
    seen = set()
    for i, text in enumerate(texts):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        assert got[i] == (sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_refuses_too_long_texts(monkeypatch):
    data, starts = np.frombuffer(bytes(range(200)) * 2 + bytes(64), np.uint8), np.array([0, 400])
    assert len(substrings._anchors(data, starts)[0])
    monkeypatch.setattr(substrings, "POSITION", np.uint64(255))
    with pytest.raises(ValueError, match="400 bytes"):
        substrings._anchors(data, starts)


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = [None, "", "One  two", "one two"]
    for _ in range(3):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice((60, 200)))]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(1, len(base) // 25)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(2000)}"
            texts.append(" ".join(own[: int(len(own) * rng.uniform(0.8, 1))]))
    texts += [" ".join(["again and again and yet"] * n) for n in (20, 24, 40)]
    sets = [Counter(zip(*(w[k:] for k in range(5)), strict=False)) or Counter([tuple(w)]) for w in (minhash.words_of(t or "") for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, texts)).collect()} == dict(enumerate(label))


def test_secrets_ledger(spark):
    texts = ["password = 'abcdefgh1'", "PassWord: short", "AKIA" + "Q7" * 8, "f" * 40, None, "password = 'abcdefgh1'"]
    found, ledger = secrets.scan_blobs(frame(spark, texts))
    got = {r.doc_id: r for r in secrets.digest(found).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(6)] == [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 0, 0)]
    assert got[0].spans == "assign:0:21" and ledger.count() == 5
    again, new = secrets.scan_blobs(frame(spark, [*texts, "token=xyzxyzxyz"]), ledger)
    assert new.count() == 1 and again.where("size(findings) > 0").count() == 5


def test_bpe():
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(open(public.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    coder, known = bpe.Coder(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for text in ["", "a" * 3000, "ab" * 2000, "日本語 🙂", " \x1c\x85 x"] + ["".join(rng.choice("abcdé ö1-\n") for _ in range(80)) for _ in range(100)]:
        ids = coder.encode(text)
        assert ids == known.encode_ordinary(text) and coder.decode(ids).decode() == text


def test_html():
    weights, coupling = html.train(html.labelled_pages())
    right = total = 0
    for page in html.labelled_pages(60, seed=11):
        nodes, blocks = html.parse(page)
        p = dict(zip(map(id, nodes), html.marginals(nodes, weights, coupling), strict=True))
        right += sum((p[id(n)] >= 0.5) == (bool(n.label) and not n.never) for n, _ in blocks)
        total += len(blocks)
    assert right >= 0.98 * total
    page = "<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three.<script>x</script><p>Four</article><footer>&copy; F</footer>"
    assert html.main_text(page, weights, coupling) == "T & U\n\nOne two three.\n\nFour" and html.main_text("", weights, coupling) == ""


def test_html_drops_nothing_that_the_contract_keeps():
    model = html.own_model()
    page = "<body><article><h1>T</h1><p>Let <math><mi>x</mi></math> be <label>so</label>, as <a class='more' href=/>told</a>.</p><p hidden>Not shown, but text.</p><noscript><p>Plain text, too.</p></noscript></article></body>"
    assert html.main_text(page, *model) == "T\n\nLet x be so, as told.\n\nNot shown, but text.\n\nPlain text, too."
    page = '<body><article><p>One thing, and more. <span class="advert">Buy <b>now</b>!</span> Then another.</p></article></body>'
    assert html.main_text(page, *model) == "One thing, and more. Then another."
    for attribute in (' data-title="A hidden gem"', ' class="hidden md:block"'):
        assert not html.Node("div", None, attribute).never


def test_media(spark):
    for size in (0, 1, 575, 576, 577, 5000):
        length, data = media.store(b"a" * size)
        assert length % 576 == 0 and media.decode_image(data).tobytes()[:size] == b"a" * size
    image = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert np.allclose(media.area_resize(image, 1, 1), image.mean())
    assert media.media_columns(frame(spark, [None, "x"]), files=False).where("payload_bytes = 576").count() == 2


def test_toxicity(spark):
    model = toxicity.Model(words=["stupid", "worthless"], spelt=["stupid", "worthless"])
    model.prepare()
    assert model.features("'til you stupid thing !")[4] == 0
    assert [model._strength(w) > 0 for w in ("stupid", "stupd", "stup1d", "w0rthles", "the", "student")] == [True, True, True, True, False, False]
    assert model.features('he said "stupid" twice')[1] < model.features("you stupid thing")[1]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["so", "it", "was", "a", "day"] + ["scumbag", "vermin"] * (i % 3 == 0)) for _ in range(30)), int(i % 3 == 0)) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[i].predicted == t for i, _, t in rows if got[i].held_out) >= 0.95 * sum(r.held_out for r in got.values())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_toxicity_matches_the_whole_lexicon():
    rng = random.Random(4)
    words = ["scum", "idiot", "idiots", "abcdefgh", "abcdefghz", "x" * 45, *("".join(rng.choice("abcde") for _ in range(rng.randint(4, 14))) for _ in range(400))]
    model = toxicity.Model(words=words, stems=["idiot"])
    model.prepare()
    assert [model._strength(w) for w in ("scvm", "skum", "scm", "idjot", "idjots", "x" * 44 + "y", "other")] == pytest.approx([0.7] * 5 + [0.7, 0.0])
    for word in words[6:] * 3:
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(("", "a", "e" + word[at])) + word[at + 1 :]
        if len(word) > 2:
            near = min((e for w in words if abs(len(w) - len(word)) < 3 and (e := edits(word, w)) <= (1 if len(w) < 9 else 2)), default=None)
            assert model._strength(word) == (0.0 if near is None else pytest.approx(0.7**near)), word


def test_toxicity_terms_joined_by_punctuation():
    model = toxicity.Model(words=["idiot", "moron"], known=["other", "words"])
    model.prepare()
    joined = ["idiot/moron", "idiot,moron", "idiot...you", "so_idjot", "other/words", "id-iot", "a" * 50 + "/moron"]
    assert [model._strength(w) for w in joined] == pytest.approx([2.0, 2.0, 1.0, 0.7, 0.0, 1.0, 1.0])


def test_toxicity_misspelt_rare_terms(spark):
    terms = [a + b + "qu" for a in ("kr", "bl", "zw", "fn", "gl", "pst", "vr", "dw") for b in "aeiou"] * 2
    terms = [t if i < 40 else t[::-1] for i, t in enumerate(terms)]
    rows = [(i, "it was so " + (" ".join(terms[(i + k) % 80] for k in range(3)) if i % 2 else "a day"), i % 2) for i in range(3200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs.drop("toxic"), labels)
    model.prepare()
    assert {*terms} <= {*model.words} and all(model._strength("x" + t[1:]) > 0 for t in model.words)


def test_line_dedup(spark):
    texts = ["Posted by user 17 on Monday at noon\nfirst own line is here", "short\nPosted by user 23 on Monday at noon", None, "Posted by user 17 on Monday at noon", ""]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert [got[i].text for i in range(5)] == [texts[0], "short", "", "", ""] and got[0].n == 0


def test_line_dedup_drops_short_repeats(spark):
    long = "長い行" * 500
    texts = ["All rights reserved.\n\nown a", "own b\n\nAll rights reserved.\n" + long, "Share\nown 1", long + "\nown 2\n \nShare", "twice\ntwice\n \n\r", "\r"]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == [(texts[0], 0), ("own b\n\n" + long, 1), (texts[2], 0), ("own 2\n ", 2), (texts[4], 0), ("\r", 0)]


def test_mixing(spark):
    rows = [(i, ("der und die " if i % 4 == 0 else "the and of ") * (5 + i % 7), "de" if i % 4 == 0 else "en") for i in range(200)] + [(900, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = mixing.labelled(docs, docs.select("doc_id"))
    got = mixing.mix(docs, table, {"de": 1.0, "en": 1.0}).collect()
    totals = {d: sum(r.n_tokens * r.posteriors[d] * r.rate for r in got) for d in ("de", "en")}
    assert len(got) == 201 and abs(totals["de"] / totals["en"] - 1) < 0.01 and min(r.rate for r in got) >= 0
    assert {r.doc_id for r in mixing.mixed(docs, table).collect()} == {r[0] for r in rows}


def test_mixing_fits_to_the_end(spark, caplog):
    soft = spark.createDataFrame([(100, 0.52, 0.48), (100, 0.48, 0.52), (100, 0.5, 0.5)], "n_tokens long, p0 double, p1 double")
    _, goal, reached = mixing.fit(soft, 2, [0.515, 0.485], 0.0, 0.5)
    assert reached == pytest.approx(goal, rel=2e-5)
    docs = spark.createDataFrame([(i, "der die das " if i % 2 else "the and of ", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    mixing.mix(docs, mixing.labelled(docs, docs.select("doc_id")), {"de": 1.0, "en": 0.0})
    assert "WARNING" in [r.levelname for r in caplog.records if r.name == mixing.__name__ and "target" in r.message]


def test_mixing_keeps_every_domain(spark):
    table = spark.createDataFrame([(f"d{i}", f" w{i} w{i} ") for i in range(70)], "domain string, text string")
    assert len(mixing.train(table).domains) == 70
    with pytest.raises(ValueError, match="xx"):
        mixing.mix(frame(spark, ["w1"]), table.where("domain < 'd11'"), {"d1": 1.0, "xx": 1.0})
