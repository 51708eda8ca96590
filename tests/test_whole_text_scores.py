"""Scores of whole texts against brute-force Levenshtein over characters."""

import unicodedata

from docgauge.queries import whole_text_scores


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_whole_turns_are_scored(spark, tmp_path):
    turns = ["caf\u00e9 \u201cquoted\u201d", "cafe \u201equoted\u201c", "\u041f\u0440\u0438\u0432\u0435\u0442", "\u041f\u043e\u043a\u0430 \U0001f600", "\uff21\uff22", "AB", None, "\u4f60\u597d"]
    spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(turns)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r["turn"]: r for r in whole_text_scores(spark, str(tmp_path)).collect()}
    clean = [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in turns]
    assert len(rows) == len(turns) - 1
    for i, (a, b) in enumerate(zip(clean, clean[1:], strict=False)):
        distance = levenshtein(a, b)
        assert rows[i]["text_edit_distance"] == distance and rows[i]["text_exact_match"] == float(a == b)
        assert rows[i]["text_cer"] == (round(distance / len(a), 6) if a else float(bool(b)))
