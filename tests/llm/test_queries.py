"""The queries over the small tables against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

import public_tokenizers
from sparkloom.llm import queries as Q
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark, sf):
    return {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def test_op1(spark, sf, docs):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op1_simhash(spark, sf).collect()}
    assert found == brute.near(docs)


def test_op2(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in Q.op2_tokens(spark, sf).collect()}
    start = 0
    assert rows.keys() == docs.keys()
    for i in sorted(docs):
        ids = t.encode(docs[i] or "", add_special_tokens=False).ids + [0]
        assert (rows[i]["start"], rows[i]["n_tokens"]) == (start, len(ids))
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_op3(spark, sf, pages):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    verdicts = {}
    for r in Q.op3_urls(spark, sf).collect():
        url = pages[r["page_id"]][0] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        assert (r["host"], r["path"]) == (host.lower(), path)
        fits = []
        for rule in rules:
            name, slash, start = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append(rule)
        best = max(fits, key=len, default=None)
        assert r["rule"] == best
        if best:
            assert r["verdict"] == rules[best]
        else:
            verdicts[host] = r["verdict"]
    right = [(v == "block") == any(x in h for x in ("spam", "pills", "casino", "bets", "adult", "ads-")) for h, v in verdicts.items() if h]
    assert sum(right) / len(right) > 0.95


def test_op4(spark, sf, pages):
    rows = {r["page_id"]: r for r in Q.op4_warc(spark, sf).collect()}
    assert rows.keys() == pages.keys()
    last = {}
    for i, (_, html) in pages.items():
        last[html or ""] = max(i, last.get(html or "", i))
    for i, (_, html) in pages.items():
        data = (html or "").encode()
        revisit = len(data) >= 1000 and last[html or ""] != i
        assert rows[i]["payload_bytes"] == len(data)
        assert rows[i]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", last[html]) if revisit else ("response", None))


def test_op5(spark, sf, docs):
    rows = {r["doc_id"]: r for r in Q.op5_fingerprints(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    order = sorted(docs)
    prints = {}
    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        mine, theirs, follows = brute.canonical(text), brute.canonical(other), brute.canonical(after)
        assert (r["near_edited"], r["near_next"]) == (float(mine == theirs), float(mine == follows))
        for form, found in ((mine, r["fingerprint"]), (theirs, r["edited_fingerprint"])):
            assert prints.setdefault(form, found) == found
    assert len(set(prints.values())) == len(prints)


def test_op6(spark, sf, docs):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    key = {r[0]: r[1] for r in spark.range(max(docs) + 1).selectExpr("id", "xxhash64(42, id)").collect()}
    expected = {r[0]: r for r in brute.shards([(i, docs[i], source[i]) for i in docs], seed_hash=key.get)}
    rows = Q.op6_sharding(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        i, _, size, crc, shard, slot = expected[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == (size, crc, shard, slot)
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_op7(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in Q.op7_sentencepiece(spark, sf).collect():
        ids = sp.encode(docs[r["doc_id"]])
        assert r["n_pieces"] == len(ids)
        assert r["pieces_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_equal"] == (sp.decode(ids) == docs[r["doc_id"]])


def test_op8(spark, sf, docs):
    rows = {r["doc_id"]: r for r in Q.op8_quality(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [rows[i]["keep"] for i, q in labels.items() if q == 1]
    assert sum(kept) / len(kept) > 0.97
    assert all(r["keep"] == (r["score"] <= r["threshold"]) for r in rows.values())


def test_op9(spark, sf, docs):
    for r in Q.op9_secrets(spark, sf).collect():
        spans = brute.base_secrets(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(brute.joined(spans).encode()).hexdigest()
        assert r["spans"] == brute.joined(brute.all_secrets(docs[r["doc_id"]]))


def test_op10(spark, sf, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in Q.op10_decontamination(spark, sf).collect()}
    assert found == {i: brute.contamination(t, items) for i, t in docs.items()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    from tests.compare import connect, duck_rows, spark_rows

    assert spark_rows(Q.queries()[name](spark, sf)) == duck_rows(connect(sf), Q.oracle_sql()[name])
