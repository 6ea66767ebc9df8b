import zlib

import corpus_pipeline
from kinelake.llm import langid, packing, secrets
from kinelake.llm.common import table
from kinelake.llm.queries import tokenizer_file

DIR = "/root/testdata/sf0.001"


def test_pipeline_equals_the_stages_by_brute_force(spark):
    from test_ngram_join import brute
    from test_scans import by_lines

    docs = table(spark, DIR, "documents")
    told = langid.identify(docs).select("doc_id", "lang_pred", "score").collect()
    keep = {r.doc_id for r in told if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep]
    rows = [(i, t) for i, (t, _, gone) in by_lines(rows).items() if not gone or (t or "").strip(" ")]
    group = brute(rows)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {}
    for r in secrets.scanned(df).collect():
        t, out, at = r.text, "", 0
        for s, _, e in sorted(tuple(x) for x in r.secrets):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        texts[r.doc_id] = out + t[at:] if r.secrets else t
    enc = packing.Encoder(tokenizer_file("word_bpe_49k.json").decode())
    ids = {i: enc([(t or "").encode()])[0] + b"\1\0\0\0" for i, t in texts.items()}
    got = {}
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
    assert got == {i: len(b) // 4 for i, b in ids.items()}


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (3, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (None, "a b c d e f g", "fr", "s", 13), (5, "123 456", "de", "s", 7), (6, "token = deadbeefdeadbeefdeadbeef here", "en", "s", 37)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, DIR)
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, DIR).count() >= d.count()
    assert {r.text for r in corpus_pipeline.redact(spark, docs, DIR).collect() if r.doc_id == 6} == {"[SECRET] here"}


def test_documents_without_any_label_stay(spark):
    docs = spark.createDataFrame([(i, f"the cat number {i}", None, "s", 16) for i in range(20)] + [(90, "12 34", None, "s", 5), (91, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, DIR).collect()) == list(range(20))
