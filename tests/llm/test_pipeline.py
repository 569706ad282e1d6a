"""The pipeline on a small corpus, end to end."""

import random

import corpus_pipeline

WORDS = "the of and was from with that this here there one two three four five six seven eight nine ten".split()


def test_stages_drop_link_redact_and_mix(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(40)}" for _ in range(60)) for _ in range(200)]
    for k in range(0, 200, 5):
        texts[k] += ". You vile grumbot there."
    texts[1] += " password=abcdefgh12345678"
    texts[3] = texts[2]
    leak = " ".join(f"leak{k}" for k in range(12))
    texts[4] += " " + leak
    texts[6] = None
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        state[name] = {x.doc_id: x for x in docs.collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = set(range(0, 200, 5))
    assert len(toxic & set(state["toxicity"])) <= 4 and len(set(range(200)) - toxic - set(state["toxicity"])) <= 4
    assert 2 in state["near_duplicates"] and 3 not in state["near_duplicates"] and 6 in state["near_duplicates"]
    assert 4 not in state["decontamination"]
    assert state["secrets"][1].text.endswith(" [REDACTED]") and state["secrets"][1].n_chars == len(state["secrets"][1].text)
    assert set(state["mixing"]) <= set(state["secrets"]) and "copy" in docs.columns


def planted(spark, folder, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, copy string, meta map<string, int>, _row long"
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"leak{k}" for k in range(12))), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_on_awkward_documents(spark, tmp_path):
    r = random.Random(9)
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(400)}" for _ in range(60)) for _ in range(60)]
    ids = list(range(60))
    texts += [None, "", texts[1], "\u00e9 " * 40, texts[2] + " token=%61bcdefgh12345678", " ".join(r.choices(WORDS, k=20000))]
    ids += [60, 61, None, None, 7, 63]
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 3 == 0 else f"s{k % 3}", None if k % 4 == 0 else len(t or ""), "c", {"k": k}, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    planted(spark, tmp_path, rows + rows[3:5])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "meta", "_row", "mix_copy"]
    got = out.collect()
    kept = {x.doc_id for x in got}
    assert kept <= set(ids) and len(kept & set(range(60))) > 20 and all(x.copy == "c" for x in got)
    assert not any("12345678" in (x.text or "") for x in got) and sum(x.doc_id == 3 for x in got) <= 2


def test_run_on_empty_tables(spark, tmp_path):
    planted(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
