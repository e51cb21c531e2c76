import json

import pytest

from lexiloom.plans import pipeline, task


def test_options():
    o = task.TaskOptions.of({"data": "a:b", "--left-pad-source": "False", "max_source_positions": "256", "eval-bleu": "true"})
    assert (o.left_pad_source, o.left_pad_target, o.max_source_positions, o.max_target_positions, o.eval_bleu, o.eval_bleu_detok) == (False, False, 256, 1024, True, "space")
    assert [o.folder(e) for e in (1, 2, 3)] == ["a", "b", "a"] and o.folder(2, training=False) == "a"
    assert o.languages({"train.en-de.en"}) == ("en", "de")
    for bad in ({"data": "a", "nothing": 1}, {"data": "a", "eval_bleu": "maybe"}):
        with pytest.raises(ValueError):
            task.TaskOptions.of(bad)
    with pytest.raises(ValueError):
        task.TaskOptions("").folder(1)
    with pytest.raises(ValueError):
        o.languages({"x"})


def test_vocabularies_agree_on_special_symbols():
    own = {"<pad>": 1, "</s>": 2, "<unk>": 3, "a": 4}
    task.check_vocabularies(own, own | {"b": 5})
    for other in (own | {"<unk>": 7}, {k: v for k, v in own.items() if k != "<pad>"}):
        with pytest.raises(ValueError):
            task.check_vocabularies(own, other)


def test_reserved_symbols():
    s = task.reserved_symbols()
    assert len(s) == len(set(s)) == 45 and "no_trans_ph/>" in s and "emoji_trans_ph9/>" in s


def test_serving_description():
    side = {"language": "en", "normalize_punctuation": True, "tokenizer": ("MosesTokenizer", {}), "subword": ("BytePairEncoder", {"codes_str": "a b"})}
    d = json.loads(json.dumps(task.serving_description(side, {"language": "zh"}, ["xEMPTY_TOKEN"], ["y"], ["<.*>"])))
    assert [t[0] for t in d["src_transformers"]] == ["DataGate", "PunctuationNormalizer", "UnescapeSpecChars", "MosesTokenizer", "BytePairEncoder"]
    assert d["src_transformers"][3][1] == {"lang": "en", "glossaries": ["<.*>"]}
    assert d["mappers"]["src_ids"][0][1]["empty_token"] == "EMPTY_TOKEN0" and d["mappers"]["trg_ids"][0][1]["empty_token"] == ""
    assert [r[0] for r in d["rectifiers"]] == ["RegexBreaker", "ChineseSciformChecker", "RegexBreaker", "RegexBreaker", "UrlPuncBreaker"]
    named = task.serving_description(side, {"language": "de"}, [], [], [], "ne_plhd", [("a", "b", "PN")])
    assert named["rectifiers"][-1] == ("NameEntityBreaker", {"lang": "en", "enable_lark": True, "word_mappings": [("a", "b", "PN")]})


def test_commands(spark):
    rows = spark.createDataFrame([(1, "ab\ncd"), (2, None), (3, "")], "i int, t string").repartition(2)
    out = pipeline.per_command(rows, "t", ["tr", "a-z", "A-Z"])
    assert sorted((r.i, r.t) for r in out.collect()) == [(1, "AB CD"), (2, ""), (3, "")]
    with pytest.raises(Exception, match="lines for"):
        pipeline.per_command(rows.where("i = 1"), "t", ["head", "-n", "0"]).collect()
