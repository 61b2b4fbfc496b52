from seamline.llm import lang_id, toxicity


def test_language_of_copies_stays_and_sample_is_bounded(spark, monkeypatch):
    rows = [("Hallo und guten Tag", "de")] * 2000 + [(f"bonjour {k} monde", "fr") for k in range(30)] + [("hot text", "en")] * 500 + [(f"the {k}", "en") for k in range(9)]
    taken = {}
    real = lang_id.fit_vectors
    monkeypatch.setattr(lang_id, "fit_vectors", lambda v, langs, **o: taken.update({x: langs.count(x) for x in langs}) or real(v, langs, **o))
    model = lang_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample_per_lang=8)
    assert model.languages == ["de", "en", "fr"] and taken == {"de": 1, "en": 8, "fr": 8}


def test_toxic_sample_counts_copies_once(spark, monkeypatch):
    texts = ["bad zorp words"] * 300 + [f"zorp {k} more" for k in range(40)] + ["nice hot text"] * 300 + [f"fine {k} text" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 340)) for i in range(len(texts))], "doc_id long, toxic int")
    sizes = []
    real = toxicity.train_nnpu
    monkeypatch.setattr(toxicity, "train_nnpu", lambda p, u, *a, **k: sizes.append((len(p), len(u))) or real(p, u, *a, **k))
    toxicity.fit(docs, labels, max_positive=20, max_unlabelled=82)
    assert sizes == [(20, 82)]
