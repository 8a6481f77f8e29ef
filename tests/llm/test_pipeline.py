"""The corpus pipeline against a brute-force version of all its stages."""
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from slipweave.llm import language, mixing
from tests.llm import brute
from tests.llm.test_overlap import _links, _sets


def _without_near_copies(docs):
    """The first document of each group of documents linked by five-word shingle sets with a similarity of 0.8 or more."""
    sets, first = _sets([r[:2] for r in docs]), {r[0]: r[0] for r in docs}
    for a, b in sorted(_links(sets)):
        low, high = sorted((first[a], first[b]))
        first = {d: low if f == high else f for d, f in first.items()}
    return [r for r in docs if first[r[0]] == r[0]]


def _expected(docs):
    """(doc_id, ids, decoded) of (doc_id, text, lang, source)."""
    fused = brute.posterior(docs, language.LANGUAGES)
    docs = [r for r in docs if fused[r[0]][0] != "und" and fused[r[0]][1] >= language.MIN_CONFIDENCE]
    kept = {d for d, _, _, stays, _ in brute.exact_groups([(d, t) for d, t, _, _ in docs]) if stays}
    docs = sorted(r for r in docs if r[0] in kept)
    docs = _without_near_copies(docs)
    rates = brute.mixing_rates([(d, t, s) for d, t, _, s in docs], mixing.WEIGHTS, mixing.OTHER)
    model, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d, t, _, s in docs:
        ids = model.encode(t, add_special_tokens=False).ids
        out += [(d, tuple(ids), model.decode(ids, skip_special_tokens=False))] * brute.poisson(rates[s], mixing.SEED, d)
    return sorted(out)


def test_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in got) == _expected(brute.documents(spark, sf_dir))


def test_stages_keep_the_columns_and_take_edge_cases(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "bpe_encoding"]
    for frame in (brute.edge_frame(spark), brute.empty_frame(spark)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == frame.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns == ["doc_id", "ids", "decoded"]
