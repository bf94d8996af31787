"""The pipeline's stages against plain versions of their decisions."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestrata.llm import mixing, secrets, sentencepieces
from tests.llm.test_dedup_mix_media_warc import plain_components, plain_print

ROWS = [
    (1, "Le chat est sur la table et il dort dans la maison avec le chien noir de la voisine", "fr", "a", 80),
    (2, "Le chat est sur la table et il dort dans la maison avec le chien noir de la voisine", "fr", "b", 80),
    (3, "The dog is in the house and the cat sleeps on the table next to the open window", "en", "a", 79),
    (4, 'The key of the house is here: token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" keep it safe', None, "b", 90),
    (5, "12345 67890 !!!", "en", "a", 15),
    (6, None, "en", None, None),
    (7, "", "fr", "a", 0),
    (8, "Un autre texte qui parle de la pluie et du beau temps sur la plage en hiver", "fr", None, 75),
    (8, "Un autre texte qui parle de la pluie et du beau temps sur la plage en hiver", "fr", None, 75),
]


def test_stages(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.identify_language(spark, docs, "")
    assert kept.columns == list(P.COLUMNS)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 8, 8] and all(r["lang"] for r in kept.collect())
    single = P.drop_near_duplicates(spark, kept, "")
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    prints = [plain_print(r["text"]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    heads = sorted(set(plain_components([r["doc_id"] for r in rows], links)))
    assert sorted(r["doc_id"] for r in single.collect()) == heads
    masked = P.mask_secrets(spark, single, "")
    assert masked.columns == list(P.COLUMNS)
    got = {r["doc_id"]: r for r in masked.collect()}
    assert "[REDACTED]" in got[4]["text"] and "24be" not in got[4]["text"] and got[4]["n_chars"] == len(got[4]["text"]) and got[3]["text"] == ROWS[2][1] and got[3]["n_chars"] == 79
    mixed = P.mix_sources(spark, masked, "")
    assert mixed.columns == list(P.COLUMNS)
    words, size = {}, {}
    for r in masked.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    target = mixing.waterfill(size.items())
    assert all(abs(words.get(s, 0) - target[s]) <= 20 for s in size)
    coded = P.encode_pieces(spark, mixed, "")
    lib = sentencepieces.Codec(sentencepieces.default_model()).lib
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in coded.collect():
        assert r["ids"] == lib.encode(text[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["ends"][-1] == len(text[r["doc_id"]].encode())
    assert coded.count() == mixed.count()


def test_secrets_are_masked_by_the_language_of_all_texts(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    enough, short = [word() for _ in range(40)], [word() for _ in range(40)]
    texts = [["the house of cards"] for _ in range(2400)]
    for words, n in ((enough, 5), (short, 4)):  # one in 500 texts are 5 of 2400
        for w in words:
            for k in r.sample(range(2400), n):
                texts[k].append(w)
    texts[7].append('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')
    rows = [(None if k == 7 else k, " ".join(t), "en", "a", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    forests, redact = [], secrets.redact
    monkeypatch.setattr(secrets, "redact", lambda docs, forest: forests.append(forest) or redact(docs, forest))
    masked = P.mask_secrets(spark, docs, "").collect()
    assert [f.language.words for f in forests] == [secrets._WORDS | {"the", "house", "cards", *enough}]
    assert len(masked) == 2400 and [r["doc_id"] for r in masked if secrets.MASK in r["text"]] == [None]


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        if k < len(P.STAGES) - 1:
            assert docs.columns == list(P.COLUMNS)


def test_whole_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    n, tokens, fine = out.agg(F.count("*"), F.sum("n_tokens"), F.min(F.col("round_trip").cast("int"))).first()
    assert n > 100 and tokens > 10000 and fine == 1
