"""Residue and its look-alikes."""

import pytest

from seriatim.llm import residue

REAL = "On arrival heart rate was 117, blood pressure 86/23, oxygen saturation 98% on 4 liters. Hemoglobin drifted from 4.9 to 4.1, transfused 6 units, no further bleeding seen."
CASES = [
    "Dear {{ patient.name }}, we saw {{ patient.unit }} in clinic on {{ patient.date }}.",
    "[INSERT AGE] tolerated [INSERT DOSE] well and was sent to [INSERT UNIT].",
    "Estimado ${provider}, informamos sobre ${unit}.\nDiagnóstico: ${sex}",
    "Lorem ipsum dodoatvel litur seclorit. Lotursecpra dofeitlo itturquaer no disbisitlo.",
    "xx XXXXX xx xxx xx xxx xxxx",
    "TBD / TBD / TBD / TBD",
    "dummy content - dummy content",
    "HTTP Status 503 - Service Unavailable\nThe note service is not available at this time. Try again in a few minutes.\nReference: 24175f8a",
    '{"status": 404, "error": "Not Found", "message": "Votre session a expiré. Veuillez vous reconnecter.", "trace": "dcc1a6d7"}',
    "<html><head><title>410 Gone</title></head><body><h1>Gone</h1><p>You do not have permission to view this report.</p><hr>693c1d32</body></html>",
    "Unhandled NullReferenceError: value was null\n   at note.merge.Fetch(line 345)\n   at note.store.Open(line 456)",
    "Chart viewer 4.2 - JavaScript is disabled in your browser; the note cannot be shown. Please enable JavaScript to view this report.",
    "Bitte aktivieren Sie JavaScript, um diesen Bericht anzuzeigen. Diese Anwendung benötigt Skripte und Cookies.",
    f"Medications:\n{REAL}\n\nFollow-up:\n<<medication list>> <<dose>> <<labs>>\n\nPhysical Exam:\n{REAL}",
    f"Medications: {REAL} Follow-up: asdf qwer zxcv asd fgh jkl; asdf Physical Exam: {REAL}",
]
#: Everyday wording that no test table was read for.
EVERYDAY = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation.",
    "404 page not found. The requested URL was not found on this server.",
    "Exception in thread \"main\" java.lang.NullPointerException\n\tat com.acme.chart.Loader.load(Loader.java:42)\n\tat com.acme.chart.Main.main(Main.java:7)",
    "[PATIENT NAME] was treated with [DRUG] and discharged on [DATE].",
    "Scripting is turned off. Switch on scripting in your browser to continue.",
    "Replace this text with your summary. Your content goes here.",
    "Checking your browser before accessing the site. This process is automatic.",
    "SQLSTATE[42S02]: relation does not exist",
    "Sie müssen JavaScript in Ihrem Browser aktivieren, um diese Seite anzuzeigen.",
    "Traceback (most recent call last):\n  File \"/srv/app/view.py\", line 12, in render\nKeyError: 'note'",
    "502 Bad Gateway\nnginx/1.18.0",
]
REAL_CASES = [
    None,
    "",
    "  \n ",
    "___",
    "NPO.",
    "No change.",
    "Stable overnight.",
    REAL,
    f"Medications:\n{REAL} Telehealth visit failed because the tablet asked to enable JavaScript; moved to phone after 57 minutes.",
    'Medications:\nPatient recites filler words ("lorem, lorem") since stroke; speech therapy seen 3 times. Wound measures 3.4 cm.',
    f"Request for records from outside hospital was denied with code 403; brother to call back in 2 days. {REAL}",
    f"Medications:\n{REAL.replace('arrival', 'arrival {{name}}')} {REAL}",
    "Session on relaxation timed out early because of palpitations; to be repeated in 5 days.",
    "12 34 56 / 7",
    "Weight: 75",
]


@pytest.fixture(scope="module")
def flagged(spark):
    # the frequencies need a corpus: real notes many times, residue rarely
    texts = [REAL + f" Sample {i}." for i in range(300)] + REAL_CASES + EVERYDAY + CASES
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, CASES[0], "x", 1), (len(texts) - 1, CASES[-1], "x", 1)]
    got = residue.residue(spark.createDataFrame(rows, "doc_id bigint, text string, section string, tf int"))
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids))
    return {texts[i] for i in ids}


@pytest.mark.parametrize("text", CASES)
def test_found(flagged, text):
    assert text in flagged


@pytest.mark.parametrize("text", EVERYDAY)
def test_everyday_wording(flagged, text):
    assert text in flagged


@pytest.mark.parametrize("text", REAL_CASES)
def test_kept(flagged, text):
    assert text not in flagged


def test_empty(spark):
    assert residue.residue(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, REAL * 5000 + "\nFollow-up: {{x}} {{y}}"), (2, "TBD " * 50000)], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in residue.residue(df).collect()) == [1, 2]


def test_numbers_do_not_hide_an_error():
    """A section of mostly ids and timestamps beside an error message is a candidate."""
    text = "Service Unavailable 24175f8a 12:40:11 99 17 2024.11.26 5 6 7 8"
    (windows,) = residue.sections(text)
    assert residue.retrieved(windows)[0]


def test_the_exemplar_of_most_weight(spark):
    """Most shared tokens are not most weight: all exemplars past the gate are scored."""
    ids = "Reference: 24175f8a 12:40:11 99 17 5 6 7 8 9"
    texts = [REAL + f" Sample {i}." for i in range(300)] + [f"Service Unavailable. {ids}"]
    got = residue.residue(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert [r["doc_id"] for r in got.collect()] == [300]
    by = residue.retrieved([["permission", "denied", "server", "error"]])[0]
    assert len(by) > 1


def test_exemplars_of_the_caller(spark):
    df = spark.createDataFrame([(1, "Record sealed by court order."), (2, REAL), (3, "TBD")], "doc_id bigint, text string")
    got = residue.residue(df, exemplars=[("sealed", "Record sealed by order of the court.")])
    assert [(r["doc_id"], r["label"]) for r in got.collect()] == [(1, "sealed")]
