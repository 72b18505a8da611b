"""The corpus pipeline: every stage on what the one before kept."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from docengine.llm import bpe, near_dedup


def test_stages(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(120)]
    toxic = {i: f"{t} zgrok zgrux you zgrok" for i, t in enumerate(texts) if i % 3 == 0}
    texts = [toxic.get(i, t) for i, t in enumerate(texts)]
    near = texts[1].split()
    near[40] = "changed"
    texts += [texts[1], texts[2], " ".join(near), None, ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"{n}.parquet"))
        docs = spark.read.parquet(str(tmp_path / f"{n}.parquet"))
        assert n == 4 or docs.columns == columns, name
        seen.append({x["doc_id"] for x in docs.collect()})
    clean = set(range(len(texts))) - set(toxic)
    assert seen[0] == clean
    assert seen[1] == clean - {1, 2, 123}  # 121 is text 2 again and 120 text 1; of null and "" the larger id stays
    assert len(seen[2]) == len(seen[1]) - 1 and len({120, 122} & seen[2]) == 1
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in docs.collect():
        assert x["n_tokens"] == len(plain.encode_ordinary(texts[x["doc_id"]] or ""))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, docs.collect()))


def test_near_copies_of_odd_rows(frame):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame([(None, text, "s"), (4, text + " end", "s"), (4, text + " end", "s"), (9, None, "s"), (9, "", "s"), (None, "z", "s")])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted([(4, text + " end"), (9, ""), (None, "z")], key=str)
