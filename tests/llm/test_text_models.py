import numpy as np

from spanlex.llm import personal_data, personal_training, quality_training, text_quality

PROSE = "It was seen that the level of the serum was increased in most of the patients, and the change was not small. " * 3
TABLE = "\n".join(f"serum{i} | + | n.d. | {i}.5 | 4.0±0.1" for i in range(30))


def test_statistics(spark):
    rows = [(1, "One two.\r\n\r\nThree, 4 x_y!", 1), (2, "", 1), (3, None, 1), (4, "  \n ", 1), (1, "the cat", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = [r.asDict() for r in text_quality.statistics(frame, ["the", "one"]).orderBy("doc_id", "n_words").collect()]
    assert [r["n_words"] for r in got] == [2, 5, 0, None, 0]
    full = got[1]
    assert (full["n_lines"], full["n_chars"], full["punct_lines"]) == (2, 18, 1.0)
    assert abs(full["mean_word"] - 3.0) < 1e-9 and abs(full["common_share"] - 0.2) < 1e-9
    assert abs(full["symbol_ratio"] - 4 / 18) < 1e-9 and abs(full["digit_ratio"] - 1 / 18) < 1e-9
    assert got[2]["mean_word"] is None and got[2]["n_chars"] == 0 and got[3]["n_chars"] is None


def test_rules_on_examples(spark):
    long = "word " * 60_000
    rows = [(1, PROSE), (2, TABLE), (3, PROSE + "\n" + TABLE[:150]), (4, PROSE[:60] + "\n" + TABLE), (5, TABLE[:70]), (6, None), (7, ""), (8, PROSE.upper()), (9, long)]
    got = {r["doc_id"] for r in text_quality.not_running(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2, 4, 9}


#: Running text in languages without listed function words.
FOREIGN = (
    "Было показано, что уровень сыворотки был повышен у большинства больных, и изменение не было малым. Кроме того, в группе не было ни одного случая, при котором бы это не было так, и у всех больных, за исключением трёх, это было видно.",
    "Det visade sig att nivån i serum var högre än i den andra gruppen, och att det inte var en liten skillnad. Av de som fick det var det en som inte kunde se det, och i den andra gruppen var det två.",
    "Wykazano, że poziom w surowicy był wyższy niż u innych osób i że nie była to mała zmiana. W tej grupie nie było osoby, u której by to się nie stało, a u tych, którzy to mieli, nie było to tak jasne. Nie jest to jednak tak, że to się nie stało.",
    "Hastaların çoğunda serum düzeyi yüksek bulundu ve bu değişim az değildi. Bu durum ilk gün de var idi, ama bir kişi de bunu söylemedi. Bu da bir kez daha şunu gösterdi ki bu ilaç az da olsa iyi bir etki yapar ve bu etki uzun sürer.",
    "研究结果表明，血清水平在大多数患者中升高。变化不小，并且在第二天仍然存在。所有的患者都接受了治疗，没有人死亡。" * 2,
)


def test_running_text_of_any_language(spark):
    rows = [(i, t) for i, t in enumerate(FOREIGN)] + [(100 + i, "\n".join(t[k : k + 60] for k in range(0, len(t), 60)).upper()) for i, t in enumerate(FOREIGN[:4])]
    lists = ["\n".join(f"{mark}{w} {v}" for w in "scar rash wall cornea relapse stomach bladder kidney uterus".split() for v in ("low", "high", "mean")) for mark in ("o ", "  o ", "- ", "")]
    bad = " ".join(f"Ãâ{w}¿ï" for w in "scar rash wall cornea relapse stomach bladder kidney uterus".split() * 3)
    rows += [(1000 + i, t) for i, t in enumerate([*lists, bad])]
    got = {r["doc_id"] for r in text_quality.not_running(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1000 + i for i in range(5)}


def test_scripts_absent_from_training(spark):
    import random

    r = random.Random(8)
    texts, truth = [], []
    for letters in ("աեէըիոօբգդզկլմնպստրցք", "აეიოუბგდვზკლმნპრსტხ"):
        assert letters not in quality_training.SCRIPTS
        for _ in range(30):
            language = quality_training.Language(r)
            language.letters = letters
            own = lambda low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))  # noqa: B023, E731
            language.short, language.parts = [own(1, 3) for _ in range(15)], [own(1, 3) for _ in range(30)]
            texts += [language.text(r, 600), "\n".join(f"{language.word(r)} {language.word(r)}" for _ in range(40))]
            truth += [False, True]
    x = quality_training.features(spark, texts)
    said = np.any([quality_training.covers(rule, x) for rule in text_quality.load_rules()], axis=0)
    assert (said == np.array(truth)).mean() > 0.9


def test_held_out_accuracy(spark):
    texts, truth = quality_training.labelled(300, 77)
    x = quality_training.features(spark, texts)
    said = np.any([quality_training.covers(rule, x) for rule in text_quality.load_rules()], axis=0)
    assert (said & truth).sum() / said.sum() > 0.93
    assert (said & truth).sum() / truth.sum() > 0.93


def test_induction_finds_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(text_quality.FEATURES)))
    y = x[:, 0] < 0.3
    rules = quality_training.induce(x, y)
    said = np.any([quality_training.covers(r, x) for r in rules], axis=0)
    assert (said == y).mean() > 0.97


def test_held_out_spans():
    report = personal_training.measure(personal_data.load(), 99, 150)
    for kind in personal_data.KINDS:
        assert report[kind]["precision"] > 0.95 and report[kind]["recall"] > 0.95, (kind, report[kind])


def test_held_out_names_absent_from_training():
    lexicon = personal_data.load().lexicon
    assert not any(lexicon[w] for w in personal_training.UNSEEN_GIVEN + personal_training.UNSEEN_SURNAMES)
    report = personal_training.measure(personal_data.load(), 98, 300, personal_training.Unseen)["name"]
    assert report["precision"] > 0.95 and report["recall"] > 0.94, report


def test_names_without_known_words_or_cues():
    model = personal_data.load()
    assert model.redact("Ravi Patel reviewed the slides.") == "[NAME] reviewed the slides."
    assert model.find("The Renal Output In Rats was low. Norvale General Hospital was closed.") == []


def test_names_of_many_forms():
    find = lambda t: [t[s.start : s.end] for s in personal_data.load().find(t) if s.kind == "name"]
    assert find("The letter came from John Smith and Aisha Khan last week.") == ["John Smith", "Aisha Khan"]
    assert find("Patient Robert Miller was admitted by nurse Wang Wei.")[:1] == ["Robert Miller"]
    assert find("according to priya sharma and omar hussein, the dose was low.") == ["priya sharma", "omar hussein"]
    assert find("\ufeffHiroshi Tanaka (ssn 912-11-2222; home 222-555-0199) refused the biopsy.") == ["Hiroshi Tanaka"]
    address = [s for s in personal_data.load().find("She lives at calle Mayor 14, Norvale.") if s.kind == "address"]
    assert [(s.start, s.end) for s in address] == [(13, 27)]


def test_cues_in_a_text_that_changes_length_in_lower_case():
    text = "\u0130zmir. the widow of k. voskzed was reached."
    assert len(text.lower()) != len(text)
    assert personal_data.load().redact(text) == "\u0130zmir. the widow of [NAME] was reached."


def test_lookalikes_and_redaction():
    model = personal_data.load()
    text = "The patient, Mrs. Anna Voskhurst, SSN: 666 53\r\n4222, lives at Flat 3, 12 Sallowby Rd.; e-mail a.b (at) ward7 (dot) invalid, tel/fax (882) 555-0157."
    assert model.redact(text) == "The patient, Mrs. [NAME], SSN: [ID_NUMBER], lives at [ADDRESS]; e-mail [EMAIL], tel/fax [PHONE]."
    for line in ("Lot 8358-4581-57 of the antigen was used.", "The sign of Haskanek was absent.", "Tubes were kept @ 12 c for 13 min."):
        assert model.find(line) == []
    assert model.find(None) == [] and model.redact(None) is None and model.redact("") == ""


def test_best_division_is_optimal():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(60):
        spans = sorted({personal_data.Span(a, a + r.randint(1, 6), "name") for a in (r.randint(0, 12) for _ in range(8))}, key=lambda s: (s.end, s.start))
        score = [r.uniform(-2, 3) for _ in spans]
        best = 0.0
        for pick in itertools.product((0, 1), repeat=len(spans)):
            chosen = [s for s, p in zip(spans, pick) if p]
            if all(a.end <= b.start or b.end <= a.start for a, b in itertools.combinations(chosen, 2)):
                best = max(best, sum(x for x, p in zip(score, pick) if p))
        got = personal_data.best_division(spans, score)
        assert abs(sum(score[spans.index(s)] for s in got) - best) < 1e-9


def test_tables(spark):
    rows = [(1, "We thank K. Voskhurst for it.", "x"), (1, "We thank K. Voskhurst for it.", "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000 + "tel/fax 897-555-0185.", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = sorted(map(tuple, personal_data.find(frame).collect()))
    assert got == [(1, "name", "K. Voskhurst"), (4, "phone", "897-555-0185")]
    assert personal_data.redact(frame).count() == 5
    assert personal_data.find(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
