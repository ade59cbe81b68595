import hashlib
import random

import pytest

import corpus_pipeline as cp
from wayloom.llm import bpe, fm_quality, line_dedup
from wayloom.session import written

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("mar", "tel", "son", "vi", "ro") for b in ("an", "eth", "ou", "il", "ay", "um", "os", "id")]
    line = lambda n=14: " ".join(rng.choice(words) for _ in range(n))
    text = lambda k=8: "\n".join(line() for _ in range(k))
    shared = "\n".join(line(20) for _ in range(3))
    item = line(40)
    docs = [(i, text()) for i in range(150)]
    docs += [(200 + i, "!!! ".join(rng.choice(("BUY", "$$$", "NOW", "###")) for _ in range(60))) for i in range(50)]
    docs += [(300, docs[3][1]), (301, docs[3][1]), (302, text(3) + "\n" + shared), (303, shared + "\n" + text(3)), (304, text(3) + "\n" + item + " end\n" + text(2)), (305, None), (306, docs[5][1].replace("\n", " ", 1).replace("mar", "MAR"))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs if i < 250], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages_against_plain_python(spark, folder):
    path, docs, item = folder
    got = {r.doc_id: r for r in cp.run(spark, path).collect()}
    from test_line_dedup import brute
    from test_simhash import jaccard

    first = spark.read.parquet(f"{path}/documents.parquet")
    ok = {r.doc_id for r in fm_quality.predictions(first, spark.read.parquet(f"{path}/labels.parquet")).where("predicted = 1").collect()}
    assert not ok & set(range(200, 250)) and set(range(150)) <= ok
    left = {i: t for (i, _), t in brute([d for d in docs if d[0] in ok], line_dedup.MIN_WORDS).items()}
    left = {i: t for i, t in left.items() if t and t.split()}
    kept = {}
    for i in sorted(left):
        if not any(jaccard(left[i], t) >= 0.8 for t in kept.values()):
            kept[i] = left[i]
    kept = {i: t for i, t in kept.items() if item not in t}
    assert set(got) == set(kept)
    enc = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    for i, t in kept.items():
        assert got[i].n_tokens == len(enc.encode(t, add_special_tokens=False).ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert 304 not in got and 302 in got and 300 not in got and 306 not in got


def test_stages_keep_columns_and_odd_rows(spark, folder, odd):
    path = folder[0]
    docs = odd
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, path))
        assert docs.columns == odd.columns
    assert "doc_id" in cp.STAGES[-1][1](spark, docs, path).columns


def test_empty_table(spark, folder, none):
    docs = none
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, folder[0]))
    assert docs.count() == 0
