import zlib

from pagetide.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = langid.fit(docs)
    out = {r.doc_id: r for r in langid.identify(docs, models).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2 and truth[i]]
    right = sum(out[i].lang_pred == truth[i] for i in held)
    assert right / len(held) > 0.97, (right, len(held))
    assert sum(out[i].rejected for i in held) / len(held) < 0.01
    assert all(0 <= r.score <= 1 for r in out.values())
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "123 !!", 5), (4, "qzx kwv zzq xqk jjw qqx " * 40, 5), (4, "the and of that", 5), (None, "the and", 5)], "doc_id long, text string, score int")
    found = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in langid.identify(odd, models).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (4, False, True), (4, False, False)} <= found
    assert langid.identify(odd.limit(0), models).count() == 0
    assert langid.keep_identified(odd, models).columns == odd.columns


def test_no_labelled_text_and_few_documents(spark, tmp_path):
    import corpus_pipeline
    from pagetide.llm import entries

    docs = spark.createDataFrame([(1, "the and of that", None), (2, None, "en"), (None, "the and", "en")], "doc_id long, text string, lang string")
    for name, table in (("empty", docs.limit(0)), ("unlabelled", docs)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = entries.op4_language_id(spark, str(tmp_path / name)).collect()
        assert [(r.lang_pred, r.score, r.rejected) for r in found] == [("und", 0.0, True)] * table.count()
        assert corpus_pipeline.language_id(spark, table, "").count() == 0
    # hashes deal these documents to calibration
    calibrate = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    ids = spark.createDataFrame([(i,) for i in calibrate], "doc_id long").where("pmod(xxhash64(doc_id, 1), 5) = 0").limit(7).collect()
    words = {"en": "the and of that with this from water house", "de": "der die und nicht mit haus wasser leute über"}
    for n in (1, 7):
        rows = [(r.doc_id, words["en"], "en") for r in ids[:n]] + [(1000 + i, words["de"], "de") for i in range(40)]
        few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        models = langid.fit(few)
        assert models.languages == ["de", "en"]
        assert {(r.doc_id, r.lang_pred) for r in langid.identify(few, models).collect()} == {(r[0], r[2]) for r in rows}
