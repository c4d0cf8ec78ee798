import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.text import normalise, normalise_all
from lectern.operators import questions as Q
from lectern.operators.rewrite import clean_topic, rewrite_questions

CHUNK = (
    "chunk_id string, document_id string, chunk_index int, text string, token_count int, "
    "section_path array<string>, page_start int, page_end int"
)


def candidates(spark, text, path=None):
    frame = spark.createDataFrame([(text, path)], "text string, section_path array<string>")
    return [(c.question_type, c.answer, c.support) for c in Q.extract_candidates(frame).first().candidates]


def of_type(found, kind):
    return [c[1] for c in found if c[0] == kind]


def test_heading_must_stand_in_the_text(spark):
    assert of_type(candidates(spark, "ACCÈS  au réseau\nUne phrase.", ["x", "Accès au Réseau"]), fixed.TYPE_STRUCTURE)
    assert not of_type(candidates(spark, "autre chose", ["Accès"]), fixed.TYPE_STRUCTURE)
    assert of_type(candidates(spark, "Première ligne\nfin"), fixed.TYPE_STRUCTURE) == ["Première ligne"]


def test_every_rule_fires_once(spark):
    text = (
        "Titre de section\nLa capacité désigne le droit. Le sillon désigne autre chose.\n"
        "Voir l'article L2122-3 du code des transports, puis la suite.\n"
        "Il y a 12 trains par heure.\nDemande au plus tard le 3 mai, sinon rien.\n"
        "a) le dossier doit rester complet\nSNCF Réseau gère les voies ferrées"
    )
    found = candidates(spark, text)
    assert of_type(found, fixed.TYPE_DEFINITION) == ["La capacité désigne le droit.", "Titre de section"]
    assert of_type(found, fixed.TYPE_LEGAL) == ["article L2122-3 du code des transports"]
    assert of_type(found, fixed.TYPE_QUANTITY) == ["12 trains"]
    assert of_type(found, fixed.TYPE_DEADLINE) == ["au plus tard le 3 mai"]
    assert of_type(found, fixed.TYPE_PROCEDURE) == ["a) le dossier doit rester complet"]
    assert of_type(found, fixed.TYPE_ROLE) == ["SNCF Réseau gère les voies ferrées"]


@pytest.mark.parametrize(
    "sentence, answer",
    [
        ("En 2025, 12 trains circulent", None),
        ("Soit 12 % des trains du jour", None),
        ("Soit 12 trains de ce jour là", "12 trains"),
        ("Soit 3,5 km de voie ferrée", "3,5 km"),
        ("Ouverture prévue dès 14h30 ici", "14h30"),
        ("Le délai court dès J-15 inclus", "J-15"),
    ],
)
def test_quantities(spark, sentence, answer):
    found = of_type(candidates(spark, sentence), fixed.TYPE_QUANTITY)
    assert found == ([answer] if answer else [])


def test_long_deadline_is_cut_to_the_match(spark):
    assert of_type(candidates(spark, "Réponse avant le " + "x" * 200), fixed.TYPE_DEADLINE) == ["avant le"]


def test_support_is_the_clause_with_the_answer(spark):
    long = "début " + "x" * 300 + " ; il y a 12 trains ici ; " + "y" * 300
    found = {c[0]: c[2] for c in candidates(spark, long)}
    assert found[fixed.TYPE_QUANTITY] == "il y a 12 trains ici"
    frame = spark.createDataFrame([("mot " * 200,)], "s string")
    cut = frame.select(Q.short_support(F.col("s")).alias("c")).first().c
    assert cut == " ".join(["mot"] * 150)[:599].rsplit(" ", 0)[0] and len(cut) <= 600


def test_texts_beyond_latin_take_the_python_fold(spark):
    found = candidates(spark, "Les ﬁches désignent tout\nLa ﬁche désigne le train établi")
    assert "La ﬁche désigne le train établi" in of_type(found, fixed.TYPE_DEFINITION)


def test_rotation(spark):
    def chosen(n, index):
        items = [("t", f"q{i}", "a", "s") for i in range(n)]
        frame = spark.createDataFrame(
            [(items, index)],
            "c array<struct<question_type:string,question:string,answer:string,support:string>>, i int",
        )
        picked = Q.select_candidates(F.col("c"), F.col("i"))
        return [x.question for x in frame.select(picked.alias("p")).first().p]

    for n in (1, 2, 5):
        for index in range(12):
            wanted = ["q0" if n == 1 or index % 3 == 0 else f"q{1 + index % (n - 1)}"]
            if n > 2 and index % 4 == 0:
                extra = f"q{2 + index % (n - 2)}"
                wanted += [extra] if extra not in wanted else []
            assert chosen(n, index) == wanted


def test_adversarial_numbers(spark):
    assert [Q.adversarial_count(n) for n in (0, 10, 30, 50)] == [1, 1, 2, 2]
    used, wanted = set(), []
    for j in range(12):
        at, text = (j * 37 + 11) % 2, fixed.ADVERSARIAL_QUESTIONS[j % 5]
        if (text, at) in used:
            text = text[:-1] + f" (référence {j}) ?"
        used.add((text, at))
        wanted.append((j, at, text))
    rows = Q.adversarial_questions(spark, 12, 2).orderBy("j").collect()
    assert [tuple(r) for r in rows] == wanted


def test_question_set(spark):
    rows = [
        (f"{d}_c{i}", d, i, f"Titre {i}\nLe quai {i} est ouvert à {i + 2} trains.", 10 + 400 * (i == 1), None, 1, 2)
        for d in ("drr-2026", "drr-2025")
        for i in range(6)
    ]
    chunks = spark.createDataFrame(rows, CHUNK)
    ready = Q.chunk_candidates(chunks).join(chunks.select("chunk_id", "chunk_index"), "chunk_id")
    made = Q.build_questions(ready)
    items = made.orderBy("id").collect()
    n = len(items)
    assert [r.id for r in items] == [f"eval_{i:06d}" for i in range(1, n + 1)]
    answerable = [r for r in items if r.is_answerable]
    assert [r.document_id for r in answerable] == sorted(r.document_id for r in answerable)
    assert n - len(answerable) == Q.adversarial_count(len(answerable)) and not items[-1].is_answerable
    # Chunk 11 in file order is the last one of the later document.
    assert items[-1].chunk_id == "drr-2026_c5"
    assert {r.source_year for r in items} == {2025, 2026}
    assert all(r.difficulty == "medium" for r in answerable if r.question_type == fixed.TYPE_QUANTITY)
    assert all(r.violations == 0 for r in Q.question_violations(made, chunks, target=1).collect())
    broken = Q.question_violations(made.withColumn("answer", F.lit("absent")), chunks).collect()
    counts = {r.rule: r.violations for r in broken}
    assert counts["answer in chunk"] == len(answerable)
    assert counts["enough answerable items per document"] == 2
    total = [r for r in Q.question_counts(made).collect() if (r.document_id, r.question_type, r.difficulty) == (None,) * 3]
    assert [(r.n_items, r.n_answerable) for r in total] == [(n, len(answerable))]
    report = {r.document_id: r.total for r in Q.document_report(made).collect()}
    assert sum(report.values()) == n


def test_repeated_chunk_ids_keep_ids_unique(spark):
    text = "Titre\nLa capacité désigne le droit. Il y a 12 trains par heure au moins."
    rows = [(f"c{i % 3}", "d-2025", i, text, 9, None, 1, 1) for i in range(9)]
    rows += [("solo", None, 0, text, 9, None, 1, 1)]
    frame = spark.createDataFrame(rows, CHUNK)
    wanted = Q.extract_candidates(frame).select("*", F.col("token_count").alias("size"))
    items = Q.build_questions(wanted).collect()
    asked = [i for i in items if i.is_answerable]
    assert len({i.id for i in items}) == len(items)
    assert sorted(i.id for i in asked) == [f"eval_{n + 1:06d}" for n in range(len(asked))]
    pairs = [(i.question, tuple(i.gold_chunk_ids) if "gold_chunk_ids" in i else i.chunk_id) for i in asked]
    assert len(set(pairs)) == len(pairs)


@pytest.mark.parametrize(
    "title, topic",
    [
        ("1.2 OBJECTIF", "l'objectif"),
        ("3.1 Accès", "l'accès"),
        ("Redevances", "les redevances"),
        ("Process", "le process"),
        ("la gare", "la gare"),
        (" Gare", "le gare"),
        ("12 trains", "les 12 trains"),
        ("", "le "),
    ],
)
def test_topics(spark, title, topic):
    frame = spark.createDataFrame([(title,)], "t string")
    assert frame.select(clean_topic(F.col("t")).alias("c")).first().c == topic


def test_rewriting(spark):
    rows = [
        (["x", "Accès"], "amount", "?"),
        ([], "nouveau", "Que dit « 2.1 Gares » ?"),
        (None, None, "Que dit « Gares » ?"),
        (None, "list", "sans titre"),
        (["x", ""], "list", "inchangée « y »"),
    ]
    frame = spark.createDataFrame(rows, "section_path array<string>, question_type string, question string")
    assert [r.question for r in rewrite_questions(frame).collect()] == [
        "Quels sont les montants ou chiffres clés pour l'accès ?",
        "Pouvez-vous m'en dire plus sur les gares ?",
        "Que faut-il savoir sur les gares ?",
        "sans titre",
        "inchangée « y »",
    ]


def test_a_clause_with_a_ligature_is_the_one_with_the_answer(spark):
    filler = "mot " * 140
    text = f"{filler}; premier; l\u2019e\ufb00et utile; l\u2019effet inutile; {filler}"
    frame = spark.createDataFrame([(text, "l\u2019effet")], "s string, a string")
    folded = frame.select("s", "a", normalise(F.col("a")).alias("low"), normalise_all(Q._clauses(F.col("s")), F.lit(True)).alias("lows"))
    chosen = folded.select(
        Q.short_support(F.col("s"), F.col("a"), F.col("low"), F.col("lows")).alias("full"), Q.short_support(F.col("s"), F.col("a")).alias("jvm")
    ).first()
    assert chosen.full == "l\u2019e\ufb00et utile" and chosen.jvm == "l\u2019effet inutile"


def test_a_long_unit_takes_the_clause_whose_full_form_has_the_answer(spark):
    filler = "texte sans rien " * 45
    chunk = f"{filler} : au plus tard le jour \ufb01xé de l\u2019article L. 2111-9 : article L. 2111-9 nu : {filler}."
    rows = Q.extract_candidates(spark.createDataFrame([(chunk, ["T"])], "text string, section_path array<string>")).first().candidates
    legal = [c for c in rows if c.question_type == fixed.TYPE_LEGAL]
    assert legal and "\ufb01xé" in legal[0].support
