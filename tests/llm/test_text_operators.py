"""BPE, decontamination, personal data, language: against plain definitions, over whole texts and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, language_id, pii, queries, token_counts
from docmill.llm._util import scratch_path
from tests.llm.conftest import SF

VOCABULARY = path("byte_bpe_50k.tiktoken")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_text(df, *cols):
    return {r["text"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_bpe_as_the_library(docs, rows, library):
    got = bpe.encode_decode(docs, VOCABULARY, ids=True)
    assert [c.lower() for c in got.columns].count("n_tokens") == 1 and got.count() == len(rows)
    for t, (n, a, b, ids) in by_text(got, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids").items():
        want = library.encode_ordinary(t or "")
        assert (ids, n, a, b) == (want, len(want), sha(" ".join(map(str, want))), sha((t or "").encode()))


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        want = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(" ".join(map(str, want))), sha(texts[r["doc_id"]]))


def test_prefixes_append_and_edit(library):
    v, r = bpe.vocabulary(VOCABULARY), random.Random(2)
    letters = b"abcdethe  insg\xc3\xa9\xff"
    some = lambda n: bytes(r.choice(letters) for _ in range(r.randint(0, n)))
    for _ in range(400):
        s, more = some(60), some(20)
        assert v.piece(s) == (library._encode_single_piece(s) if s else []) == ([] if not s else bpe.merge(v.ranks, s))
        p = bpe.Prefixes(v, s)
        p.append(more)
        s += more
        a = r.randint(0, len(s))
        b, new = r.randint(a, len(s)), some(8)
        p.edit(a, b, new)
        s = s[:a] + new + s[b:]
        assert p.data == s and p.ids() == v.piece(s) and v.decode(p.ids()) == s
    long = some(60) * 200
    p = bpe.Prefixes(v, long)
    p.edit(100, 103, b"zq")
    assert p.ids() == bpe.Prefixes(v, long[:100] + b"zq" + long[103:]).ids()
    with pytest.raises(KeyError):
        v.decode([60000])


def naive_windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return w, {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def naive_hits(texts, items):
    known = {}
    for i, t in items:
        for w in naive_windows(t)[1]:
            known.setdefault(w, set()).add(str(i))
    out = {}
    for t in texts:
        w, hit, held = naive_windows(t)[0], set(), set()
        for size in {len(k) for k in known}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in known:
                    hit.update(range(i, i + size))
                    held |= known[k]
        out[t] = (len(w), len(hit), len(held), sha(",".join(sorted(held))), bool(hit))
    return out


FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, docs, rows, block_bytes):
    items = [(1, rows[4][1]), (2, " ".join(rows[6][1].split()[20:31]).upper()), (3, "no ID"), (4, None), (5, "!!"), (6, rows[3][1]), (6, rows[3][1]), (10, rows[3][1]), (11, "ging ging"), (None, "white space")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, spans=True, block_bytes=block_bytes)
    want = naive_hits({r[1] for r in rows}, items)
    assert by_text(got, *FIELDS) == want and got.count() == len(rows)
    for t, (spans,) in by_text(got, "hit_spans").items():
        assert sum(len(naive_windows(t[a:b])[0]) for a, b in spans) == want[t][1]


def test_decontamination_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = naive_hits(set(docs.values()), items)
    got = queries.op7_decontamination(spark, SF).collect()
    assert len(got) == len(docs) and any(r["contaminated"] for r in got)
    assert all(tuple(r[f] for f in FIELDS) == want[docs[r["doc_id"]]] for r in got)


def test_decontamination_without_items(spark, docs, rows):
    got = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {r["n_hit"] for r in got.collect()} == {0} and got.count() == len(rows)


def test_windows_of_a_few_words_met_everywhere():
    """Many items of few different words, repeats within and among them: each range and item as by all windows."""
    r = random.Random(8)
    say = lambda n: " ".join(r.choices("abc", k=n))
    for _ in range(150):
        items = [(i, say(r.choice([0, 1, 4, 5, 9, 10, 11, 16, 40]))) for i in range(r.choice([3, 60]))]
        pieces = [t for _, t in items] + [say(7), "z", say(30)]
        texts = {" ".join(r.choices(pieces, k=r.randint(0, 5))) for _ in range(6)}
        machine, want = decontaminate.Automaton(items), naive_hits(texts, items)
        for t in texts:
            ranges, held = machine.scan(decontaminate.words(t))
            assert (sum(b - a for a, b in ranges), len(held), sha(",".join(sorted(held)))) == want[t][1:4], (items, t)


def test_automaton_memory():
    """A block of the production size takes some 20 bytes a byte of text at most."""
    import subprocess
    import sys

    code = "import random,resource;from docmill.llm import decontaminate as d;r=random.Random(1);v=[''.join(r.choices('abcdefghij',k=r.randint(2,8))) for _ in range(40000)];items=[(i,' '.join(r.choices(v,k=60))) for i in range(6000)];size=sum(len(t) for _,t in items);a=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;m=d.Automaton(items);print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss-a)*1024/size)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout
    assert float(out) < 40


def naive_base(t):
    found = []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    for kind, expression, test in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        found += [(kind, *m.span()) for m in re.finditer(expression, t) if test(m.group())]
    order = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_base_spans_on_noise():
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice("0123456789.@+-() aé,") for _ in range(r.randint(0, 60)))
        assert pii.base(t) == naive_base(t), t
    for t in ("a@b.c@d.e.f", "x@@y.z", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111111111111111", "+1 4111 1111 1111 1111", "." * 50 + "@x.y"):
        assert pii.base(t) == naive_base(t), t
    assert pii.base("9" * 20000 + " " + "9999." * 5000) == []  # linear on long runs


def test_context_moves_every_score():
    spans = {"email": "a.b@c.org", "ip": "10.0.0.7", "card": "4111 1111 1111 1111", "phone": "+1 017 555 7713", "iban": "GB82 WEST 1234 5698 7654 32", "national": "555-123-4567", "ssn": "123-45-6789"}
    near = {"email": "mail", "ip": "server", "card": "visa", "phone": "call", "iban": "bank", "national": "phone", "ssn": "SSN"}
    for kind, span in spans.items():
        for word, extra in ((near[kind], pii.GAIN[kind]), ("order", -0.2), ("nothing", 0.0), (near[kind] + " order", pii.GAIN[kind] - 0.2)):
            t = f"{word} {span} {'x ' * 30}"
            a = t.index(span)
            found = {s[:3]: s[3] for s in [(*b, pii.score(t, *b)) for b in pii.base(t)] + pii.more(t, pii.base(t))}
            want = round(min(1.0, pii.START[kind] + extra + 0.6 * (kind == "iban")), 2)
            if kind in pii.KINDS[:4] or want >= pii.KEEP:
                assert found[kind, a, a + len(span)] == want, (kind, word)
            else:
                assert not found, (kind, word)
    far = "mail " + "x" * pii.NEAR + " a.b@c.org"
    assert pii.score(far, "email", len(far) - 9, len(far)) == pii.START["email"]


def test_own_spans_are_those_of_brute_force():
    r = random.Random(12)
    parts = ["SSN 123-45-6789", "call 555-123-4567", "+1 555 123 4567", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "order", "x", "123-45-6789", "10.0.0.1", "(555) 123-4567"]
    for _ in range(300):
        t = r.choice([" ", "", ", "]).join(r.choices(parts, k=r.randint(1, 8)))
        taken = pii.base(t)
        busy, want = [s[1:] for s in taken], []
        for kind, expression in (("iban", pii._IBAN), ("national", pii._NATIONAL), ("ssn", pii._SSN)):
            for m in expression.finditer(t):
                s = pii.score(t, kind, *m.span(), 0.6 * (kind == "iban" and pii.mod97(m.group())))
                if s >= pii.KEEP and all(m.end() <= x or m.start() >= y for x, y in busy):
                    want.append((kind, *m.span(), s))
                    busy.append(m.span())
        assert pii.more(t, taken) == want, t


def test_personal_data_time_is_linear():
    import time

    for make in (lambda k: "SSN 123-45-6789 " * k, lambda k: "call 555-123-4567, " * k, lambda k: "a@b.c " * k, lambda k: "4111 1111 1111 1111, " * k, lambda k: "@" * k, lambda k: "1." * k, lambda k: "+1" * k):
        took = []
        for k in (4_000, 32_000):
            began = time.process_time()
            pii.masked(make(k))
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), make(2)


def test_personal_data(docs, rows):
    got = pii.find(docs)
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert got.count() == len(rows)
    for r in got.collect():
        want = naive_base(r["text"] or "")
        assert r["base_sha256"] == sha(line(want)) and [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[0] == k for s in want) for k in pii.KINDS[:4]]
        assert set(filter(None, line(want).split(","))) <= set(r["spans"].split(",")) and r["spans"].count(",") == r["scores"].count(",")
    full = next(t for i, t, _ in rows if i == 40)
    assert pii.masked(full) == "mail <EMAIL> or <PHONE>, <IP> card <CARD> iban <IBAN> call <NATIONAL>"
    assert pii.masked("order 555-123-4567") == "order 555-123-4567" and pii.masked("GB82 WEST 1234 5698 7654 33") == "GB82 WEST 1234 5698 7654 33" and pii.masked(None) is None and pii.masked("") == ""
    assert pii.mask(docs).columns == docs.columns


def test_personal_data_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in naive_base(docs[r["doc_id"]])))


def test_language(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        lettered = any(map(str.isalpha, truth[r["doc_id"]][1]))
        assert (r["lang_pred"] == "und") == (not lettered)
        if r["held_out"] and lettered:
            total, right = total + 1, right + (r["lang_pred"] == truth[r["doc_id"]][0])
    assert right / total > 0.9


def test_language_of_odd_rows(docs, rows, none):
    model = language_id.train(docs)
    assert model.languages == ["de", "en", "fr"]
    got = by_text(language_id.predict(docs, model), "lang_pred", "score", "ambiguous")
    for t, (lang, score, ambiguous) in got.items():
        assert (lang == "und") == (not t or not any(map(str.isalpha, t))) and 0 <= score <= 1
        assert (lang, score, ambiguous) == model.predict(t)
    empty = language_id.train(none)
    assert {v[0] for v in by_text(language_id.predict(docs, empty), "lang_pred").values()} == {"und"}
    assert language_id.train(docs, rows_per_language=1).languages  # the bound thins, it never fails


def test_language_sample_is_of_usable_distinct_texts(spark):
    rows = [("xx", None)] * 3000 + [("xx", f"quoz blim {i}") for i in range(5)] + [("yy", "the same words")] * 3000 + [("yy", f"other words {i}") for i in range(5)] + [("zz", "1 2 3")] * 9
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.train(df, rows_per_language=20)
    assert model.languages == ["xx", "yy"]
    once = language_id.train(df.distinct(), rows_per_language=20)
    assert (model.weights == once.weights).all()  # copies don't outweigh other texts


def test_texts_go_to_workers_once(spark):
    rows = [(i, f"{i} " + "some words " * 200) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id int, text string")

    def sent(df) -> int:
        todo = [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.metrics().contains("pythonDataSent"):
                return node.metrics().apply("pythonDataSent").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        raise AssertionError("no Python in the plan")

    size = sum(len(t) for _, t in rows)
    model = language_id.train(df.selectExpr("'en' lang", "text"))
    for made in (language_id.predict(df, model), language_id.predict(df.withColumnRenamed("text", "Lang_Pred"), model, "Lang_Pred")):  # also where the result takes the text's place
        assert [r["lang_pred"] for r in made.collect()] == ["en"] * 300
        assert size <= sent(made) < 1.5 * size


def test_codewords():
    for n in (2, 3, 4, 7, 12, 60):
        m = language_id.codewords(n)
        assert len({tuple(r) for r in m}) == n and all(abs(c.sum()) < n for c in m.T)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_token_counts(spark, docs, rows, library, block):
    folder = scratch_path(spark, "tokens")
    got = token_counts.document_counts(docs, folder, VOCABULARY, 50256, block_ids=block)
    want = sorted((len(library.encode_ordinary(t or "")), -1 if i is None else i) for i, t, _ in rows)
    assert sorted((r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got.collect()) == want


def test_flat_files_of_any_shape(spark, tmp_path):
    import numpy as np

    r, want = random.Random(8), {}
    for k in range(12):
        ids = [r.choice([9, 9, 1, 2, 3]) for _ in range(r.randint(0, 40))] if k else []
        np.array(ids, dtype="<u2").tofile(tmp_path / f"{k:02d}.bin")
        start = 0
        for j, x in enumerate([*ids, None]):
            if x == 9 or x is None and start < len(ids):
                want[f"{k:02d}.bin", start] = (j - start, x == 9)
                start = j + 1
    folder = f"file://{tmp_path}"
    for block in (1, 4, 7, 100):
        got = token_counts.count(token_counts.sizes(spark, folder), folder, 9, block_ids=block).collect()
        assert {(r["file"], r["start"]): (r["n_tokens"], r["ended"]) for r in got} == want
        places = {}
        for r in sorted(got, key=lambda r: (r["file"], r["at"])):
            assert r["at"] == places.setdefault(r["file"], 0)
            places[r["file"]] += 1
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of ids"):
        token_counts.count(token_counts.sizes(spark, folder), folder, 9).collect()


def test_token_count_query(spark):
    a = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, SF).collect()}
    assert a == {r["doc_id"]: r["n_tokens"] for r in queries.op3_byte_bpe(spark, SF).collect()}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert bpe.encode_decode(none, VOCABULARY).count() == 0 and pii.find(none).count() == 0 and decontaminate.contamination(none, bench).count() == 0
    assert token_counts.document_counts(none, scratch_path(spark, "t"), VOCABULARY, 50256).count() == 0
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert pii.mask(none).select(F.col("doc_id")).count() == 0


def test_many_languages(spark):
    """More languages than a worker holds sums of, each with texts of its own letters."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{k:03d}": r.sample(letters, 4) for k in range(90)}
    say = lambda k: " ".join("".join(r.choices(kinds[k], k=5)) for _ in range(30))
    df = spark.createDataFrame([(say(k), k) for k in kinds for _ in range(12)], "text string, lang string")
    model = language_id.train(df)
    assert model.languages == sorted(kinds)
    assert sum(model.predict(say(k))[0] == k for k in kinds for _ in range(4)) > 0.8 * 4 * len(kinds)


def naive_model(rows):
    """Weights and trust by the definition, over every text given."""
    languages = sorted({k for _, k in rows})
    codes = language_id.codewords(len(languages))
    share = []
    for k in languages:
        n = np.full(language_id.BUCKETS, 0.5)
        for t, lang in set(rows):
            if lang == k:
                np.add.at(n, language_id.trigrams(t), 1)
        share.append(n / n.sum())
    share = np.array(share)
    weights = np.stack([np.clip(np.log(share[c > 0].mean(0) / share[c < 0].mean(0)), -8, 8) for c in codes.T], axis=1)
    m = language_id.Model(languages, codes, weights.astype(np.float32), np.zeros(codes.shape))
    trust = np.array([[(sum(m.margins(t)[b] * codes[i, b] > 0 for t, lang in set(rows) if lang == k) + 1) / (sum(lang == k for _, lang in set(rows)) + 2) for b in range(codes.shape[1])] for i, k in enumerate(languages)])
    return weights, trust / trust.sum(1, keepdims=True)


def test_language_model_is_that_of_brute_force(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND text RLIKE '\\\\p{L}' AND n_chars < 3000").select("text", "lang").limit(60)
    rows = [tuple(r) for r in t.collect()]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    weights, trust = naive_model(rows)
    assert np.allclose(model.weights, weights, atol=1e-5) and np.allclose(model.trust, trust, atol=1e-6)
    for text, _ in rows:
        loss = (trust * np.logaddexp(0, -model.codes * model.margins(text))).sum(1)
        assert model.predict(text)[0] == model.languages[int(loss.argmin())]


def test_piece_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5_000)
    v, library = bpe.Vocabulary(VOCABULARY), bpe.vocabulary(VOCABULARY)
    r = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(r.choices("abcdefgh", k=r.choice([3, 8, 300]))) for _ in range(12))
        assert v.encode(text) == library.encode(text) and v.held < 5_000 + 12 * 3_000 and all(len(p) <= bpe.LONG for p in v.pieces)


def test_folders_of_object_stores(monkeypatch):
    asked = []

    class Known:
        FileSystem = type("FileSystem", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (None, uri))})

    monkeypatch.setattr(token_counts, "fs", Known)
    for folder in ("s3a://bucket/a/b", "s3n://bucket/a", "file:///tmp/x", "gs://bucket/x", "hdfs://host:9000/x"):
        token_counts.files_of(folder)
    assert asked == ["s3://bucket/a/b", "s3://bucket/a", "file:///tmp/x", "gs://bucket/x", "hdfs://host:9000/x"]
