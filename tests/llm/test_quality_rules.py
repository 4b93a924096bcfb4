from collections import Counter

from conftest import WORD, make

from frameloom.llm.quality_rules import judge, keep_good


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count = Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), twice, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_counts_match_brute_force(docs, rows):
    got = judge(docs).select("row.doc_id", "quality.*").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    have = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key)
    assert have == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_junk_goes_and_clean_text_stays(spark):
    clean = " ".join(f"the river{i} of stone{i} and" for i in range(30))
    junk = [clean.upper().replace(" ", "!! ").replace("THE", "TH").replace(" OF", " OV").replace("AND", "AN"), clean.replace(" ", "&&& "), "same words again " * 60, "short"]
    kept = keep_good(make(spark, [(0, clean, "en", "a"), *[(i + 1, t, "en", "a") for i, t in enumerate(junk)]]))
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert "quality" not in kept.columns and kept.columns[0] == "doc_id"


def test_empty_table(none):
    assert judge(none).count() == 0


def test_a_filter_on_the_verdict_measures_once(docs):
    long = docs.where("doc_id = 10")  # 30,000 words with very many repeated windows
    kept = judge(docs).where("quality.kept").select("row.doc_id").collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == sorted(r["doc_id"] or -1 for r in keep_good(docs).collect())
    assert judge(long).where("quality.n_repeat_words >= 0").count() == 1
