import time

import heldout_residue
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tracelode.llm import residue as R

REAL = "The surveyor put the loss on the storage side at 5294 crowns, less what Quingriar Lager SL had already returned."

FOUND = [
    ("placeholder", t) for t in (
        "Dear {{ recipient }},", "by ${date}", "$!{party}", "#{page_no}", "<%= court %>", "{%amount%}", "%(docket_no)s", "%%case.id%%", "@@address@@", "paid __amount__ then", "[[adresse]]", "<<clerk>>", "«docket_no»", "{PageNo}", "<enter party name>", "<page_no>",
        "&lt;date&gt;", "[INSERT date HERE]", "[your address]", "[page no to be completed]", "(fill in court)", "TODO: add court", "[hier seite ergänzen]", "(noch ausfüllen: betrag)", "[insérer date]", "<à compléter : montant>", "[insertar fecha]", "[AKTENZEICHEN]", "Name: ________")
] + [
    ("filler", t) for t in (
        "Lorem ipsum dolmen hendro elit sagirat nemus lumet ut lumet", "Sample text. Content to follow.", "Dies ist ein Blindtext.", "Texte d'exemple.", "Contenido pendiente.", "test test test test test test test test test tes", "Xxx xxxx xx xxxxx xxx xx xxxx.", "N.N. N.N. N.N. N.N. N.N. N.N. N.N. N.N.",
        "This page is still being written and will hold the statement of A. Mustermann.", "Title 1\nBody text\nItem 2\n...", "0123456789 0123456789 0123456789 0123456789 0123")
] + [
    ("error", t) for t in (
        "HTTP/1.1 502 Bad Gateway", "503 Service Unavailable", "Error 404", "Fehler 502", "The page you requested could not be found.", "Es ist ein interner Fehler aufgetreten.", "Vous n'avez pas accès à ce dossier.", "No se ha encontrado la página solicitada.",
        "Traceback (most recent call last):", "KeyError: 'recipient'", "java.lang.NullPointerException", '{"error": {"code": 504, "message": "No route"}}', "ORA-28075: could not open cursor", "THE DOCKET PORTAL IS DOWN FOR MAINTENANCE.", "Oops! We can't find that page.", "Warning: db_query(): connection lost in /srv/page.php on line 7")
] + [
    ("script", t) for t in (
        "Please enable JavaScript to continue.", "JS must be turned on to sign in.", "Noscript: this viewer requires scripts.", "Ohne aktives Scripting kann der Seitenbetrachter nicht starten.", "IHR BROWSER HAT JAVASCRIPT ABGESCHALTET.", "Cette application nécessite JS.", "Sin la ejecución de scripts el visor no puede iniciarse.",
        "Loading… If nothing appears, activate Javascript.", "We noticed that JS is switched off. Enable it to continue.")
]
CLEAN = [
    "", "  \n", REAL, "Ledger pages 404 to 509 concern Brohalar Marine AG; page 500 is blank on the back.", "On Saturday the docket portal answered 502 Bad Gateway for 40 minutes, and Yselle Kelerin filed the brief on paper instead.",
    "The contract obliged Radaon Depot GmbH to deliver the JavaScript for the customs form, and Garvin Rarode tested it with scripts switched off.", "In the letter template of Xantor Marine GmbH the field ${party_name} was renamed in September; letters already sent are not affected.",
    "The branch pattern is `timestep-{T}`; the renderer replaces `{{case_id}}` by the real id before a card is written.", "```python\nids = {p: n for p, n in pages.items()}\nprint(f\"{len(ids)} pages\")\n```\n" + REAL, 'Corlan Ormont printed "sample text" on the trial labels, which Dendaex Marine KG then stuck on real crates.',
    "El perito explicó que el aviso «servicio no disponible» no impidió presentar el escrito.", 'The handwritten note reads: "storage [sic] settled [illegible in the original] by Jorane Stenek".', "The exchange rate table lists $ 54 and % 41 per lot <net>, see AZ-2019-BGH-Q-556.",
    '{"event": "tool_call", "tool": "search_case", "k": 3, "n_results": 7, "error": null}', "serial | holder | account | crowns\nSN-1 | A B | escrow | 3", "<|endoftext|> </s>", REAL + "\n" + "=" * 60, REAL + "\n* * * * * * * * * * * * *", "Home | Dockets | Search | Help", "Please try again later.",
]


@pytest.mark.parametrize("kind, text", FOUND)
def test_evidence(kind, text):
    for whole in (text, f"## Page 3\n\n{text}", f"{REAL}\r\n\r\n{text}\n\n{REAL}", text.replace(" ", " ")):
        assert {k for _, k, _ in R.evidence(whole)} == {kind}, whole


@pytest.mark.parametrize("text", CLEAN)
def test_no_evidence(text):
    assert R.evidence(text) == []


@pytest.mark.parametrize("kind, text", [
    ("filler", "Lorem ipsum (1) " + "dolmen hendro 7 elit sagirat " * 20), ("error", "The page you requested could not be found in any of the lists of 2014, " + "such as the list of SN-12 or that of AZ-7, " * 15),
    ("script", "Please enable JavaScript to see " + "the exhibits 1 to 40, the ledger of 2014, " * 15), ("script", "-" * 500 + " Please enable JavaScript to see the 40 exhibits"),
])
def test_evidence_in_long_sentences(kind, text):
    assert len(text) > 400 and {k for _, k, _ in R.evidence(f"{REAL} {text}")} == {kind}
    assert R.evidence(f"{REAL} {REAL[:-1]}, and {text}") == []


@pytest.mark.parametrize("field", ["(page: to be completed)", "(page: 12, to be confirmed)", "(page:4 por completar)", "(page: ergänzen)"])
def test_field_for_a_page(field):
    assert R.evidence(f"The surveyor put the loss at 5294 crowns {field}.") == [(0, "placeholder", f"The surveyor put the loss at 5294 crowns {field}.")]
    assert R.evidence("The surveyor put the loss at 5294 crowns (page: 12), and more (page:3-4).") == []


def test_long_texts_end_soon():
    import time

    began = time.time()
    for t in ("a" * 500_000, "a b " * 100_000, "{" * 100_000, "[x " * 50_000, "no " * 100_000, "<" * 100_000, "1" * 200_000, "ab" * 200_000 + "c"):
        R.evidence(t)
    assert time.time() - began < 60


SCHEMA = "doc_id bigint, source string, text string, line string, __residue string"


def frame(spark):
    notice = "Please enable JavaScript to continue."
    data = [(i, "host", f"Statement {i} of the file.\n{notice}", "x", "x") for i in range(30)]  # a footer of every page
    data += [(100, "other", f"{REAL}\n{notice}", "x", "x"), (101, None, "Error 404", "x", "x"), (102, "other", None, "x", "x"), (103, "other", "", "x", "x"), (104, "other", REAL, "x", "x"), (104, "other", "[your name]", "x", "x"), (None, "other", REAL, "x", "x"), (105, "host", "Lorem ipsum dolmen\n" + notice.upper(), "x", "x")]
    return spark.createDataFrame(data, SCHEMA)


def test_boilerplate_is_subtracted(spark):
    df = frame(spark)
    assert rows(R.boilerplate(df), "source", "docs") == [("host", 30), ("host", 31)]  # "Statement 0 of the file." and the footer
    assert sorted(r[0] for r in R.residue(df).collect()) == [100, 101, 104, 105]
    kept = R.clean(df)
    assert kept.columns == df.columns and sorted(kept.select("doc_id").collect(), key=repr) == sorted(df.where("doc_id IS NULL OR doc_id < 100 OR doc_id IN (102, 103)").select("doc_id").collect(), key=repr)
    assert R.residue(df.limit(0)).count() == R.clean(df.limit(0)).count() == 0


def test_texts_from_elsewhere():
    """Precision and recall on texts that the tables don't hold."""
    for found, clean in (heldout_residue.FIRST, heldout_residue.SECOND, heldout_residue.THIRD, heldout_residue.FOURTH, heldout_residue.FIFTH):
        hits, wrong = sum(bool(R.evidence(t)) for t in found), sum(bool(R.evidence(t)) for t in clean)
        assert hits / len(found) >= 0.8 and hits / (hits + wrong) >= 0.9


@pytest.mark.parametrize("unit", ["«a b ", "please the page word ", "x", "<a_a_a_", '" ', "12 ", "(fill ", "{a.", "__a.", "a. b ", "[A ", "%a_", "```\n", "word word. "])
def test_a_million_characters(unit):
    began = time.time()
    R.evidence(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20


def test_footer_in_the_tables(spark, data):
    """A notice at the foot of every page of a host is subtracted; pages that are nothing but the notice are not."""
    documents = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    before = set(rows(R.residue(documents)))
    text = F.when(F.col("source") == "case_pages_north", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nThis site requires JavaScript."))).otherwise(F.col("text"))
    framed = documents.withColumn("text", text)
    bare = {(r["doc_id"],) for r in documents.where("source = 'case_pages_north'").collect() if not any(c.isalnum() for c in r["text"] or "")}
    assert len(set(rows(R.search(framed), "doc_id"))) > len(before) + 10
    assert set(rows(R.residue(framed))) == before | bare
