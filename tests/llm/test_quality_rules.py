from voxlake.llm.quality_rules import line_first_clean

GOOD = "This is the first clean line of a text, and it ends well.\nHere comes a second one with quite enough words to stay.\nA third line closes the text."


def run(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, kept string")
    return [r for r in sorted(line_first_clean(df).collect(), key=lambda r: r.doc_id)]


def repeat_words(text):
    w = text.split()
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 8)}
    return len(hit)


def test_lines_and_verdicts(spark):
    nav = "Home | News | About | Contact | Help"
    junk = "\n".join(f"Aa%%% bb### cc*** d{k}!! ee&&&" for k in range(12))
    rows = run(spark, [GOOD, GOOD + "\n" + nav + "\nAll Rights Reserved.\nHome", junk + "\n" + GOOD, None, "", " \n\t", GOOD + "\n" + GOOD, "x " * 40_000])
    assert rows[0].kept and rows[0].cleaned_text == GOOD and rows[0].n_failed_lines == 0
    assert rows[1].kept and rows[1].cleaned_text == GOOD and rows[1].n_failed_lines == 3
    assert not rows[2].kept and not rows[2].base_failed and rows[2].cleaned_text == GOOD
    for r in rows[3:6]:
        assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    assert rows[6].n_dup_lines == 3 and rows[6].base_failed
    assert rows[7].n_repeat_words == 40_000 and not rows[7].kept


def test_counts(spark):
    text = "a b c d e f g h i a b c d e f g h j #é $ü"
    r = run(spark, [text])[0]
    assert (r.n_words, r.n_repeat_words, r.n_symbols, r.word_chars) == (20, repeat_words(text), 2, 22)


def test_empty(spark):
    assert line_first_clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_of_other_languages_menus_links_and_lists(spark):
    lines = ["Startseite › Neues › Über uns › Kontakt", "https://a.example/x https://b.example/y", "• Kurzer Punkt", "ALLE RECHTE VORBEHALTEN, 2024, Verlag.", "Lire la SUITE de cet article dès demain.", "Términos de USO y más cosas que leer."]
    r = run(spark, [GOOD + "\n" + "\n".join(lines)])[0]
    assert r.n_failed_lines == len(lines) and r.cleaned_text == GOOD
    items = "\n".join("- " + " ".join(f"w{k}x{j}" for j in range(8)) + "." for k in range(12))
    ends = "\n".join(" ".join(f"v{k}x{j}" for j in range(8)) + "..." for k in range(12))
    a, b, c = run(spark, [items, ends, GOOD + "\n" + items])
    assert (a.n_bullet_lines, a.n_failed_lines, a.kept) == (12, 0, False) and (b.n_ellipsis_lines, b.kept) == (12, False) and c.kept


def test_repeated_rows_and_ties(spark):
    a, b = run(spark, [GOOD, GOOD])
    assert a.asDict() | {"doc_id": 1} == b.asDict()
