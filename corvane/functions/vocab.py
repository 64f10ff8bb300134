"""Vocabularies and rule tables, kept as data so that callers can pass their own."""

from __future__ import annotations

SENTINELS = "n/a na nil none null undefined".split()

SPECIALTIES = sorted(
    s.strip()
    for s in """
    cardiology; dermatology; emergency medicine; endocrinology; gastroenterology; general internal medicine; geriatrics; hematology;
    infectious disease; nephrology; neurology; oncology; preventive medicine; psychiatry; pulmonology; rheumatology
    """.split(";")
)

#: normalised key -> study type
STUDY_TYPES = {
    key: kind
    for kind, keys in {
        "RCT": "rct|randomised controlled trial|randomized controlled trial",
        "case series": "case series",
        "guideline": "guideline|guidelines",
        "meta-analysis": "meta|meta analysis",
        "observational": "case control|cohort|observational",
        "other": "other",
        "systematic review": "systematic|systematic review",
    }.items()
    for key in keys.split("|")
}

MATCH_STOP_WORDS = sorted(
    """about according among analysis and article clinical data effect effects event events for from into journal patient patients prevention
    randomised randomized review risk risks study that the this trial trials use used with""".split()
)

#: ordered (terms, study type) over the normalised text of a link
LINK_STUDY_RULES = [
    ("meta analysis|metaanalysis", "meta-analysis"),
    ("cochrane|systematic review", "systematic review"),
    ("consensus|guideline|recommendation|statement|uspstf", "guideline"),
    ("randomised|randomized|trial", "RCT"),
    ("case control|cohort|observational", "observational"),
]

#: ordered (regular expression without case, journal)
JOURNAL_RULES = [
    (r"new england journal of medicine|\bnejm\b", "New England Journal of Medicine"),
    (r"\bjama\b", "JAMA"),
    (r"\blancet[.]|\bthe lancet\b", "The Lancet"),
    (r"british medical journal|\bbmj\b", "BMJ"),
    (r"annals of internal medicine", "Annals of Internal Medicine"),
    (r"kidney international", "Kidney International"),
    (r"journal of the american society of nephrology|\bjasn\b", "JASN"),
    (r"diabetes care", "Diabetes Care"),
    (r"\bjacc\b", "JACC"),
    (r"\bcid\b|clinical infectious diseases", "Clinical Infectious Diseases"),
]
PUBLISHER_RULES = [(domain, name) for domain, name in (x.split("=") for x in "nejm.org=New England Journal of Medicine|jamanetwork.com=JAMA|thelancet.com=The Lancet|bmj.com=BMJ|annals.org=Annals of Internal Medicine|ahajournals.org=Circulation".split("|"))]

HIGH_CONFIDENCE = "clinicaltrials.gov cochranelibrary.com doi.org dx.doi.org pmc.ncbi.nlm.nih.gov pubmed.ncbi.nlm.nih.gov uspreventiveservicestaskforce.org".split()
EVIDENCE = (
    "thoracic.org thelancet.com springer.com sciencedirect.com rheumatology.org publications.aap.org onlinelibrary.wiley.com nejm.org "
    "ncbi.nlm.nih.gov nature.com mayoclinicproceedings.org journals.lww.com jamanetwork.com idsociety.org gastrojournal.org "
    "diabetesjournals.org cdc.gov bmj.com atsjournals.org annals.org ahajournals.org acpjournals.org acc.org academic.oup.com"
).split()
#: shops, social media and players; a show's own hosts are added by the caller
EXCLUDED = "amazon.com apple.com facebook.com instagram.com patreon.com spotify.com twitter.com x.com youtube.com".split()

SUPPORT_RANK = dict(background=1, direct=2)
CONFIDENCE_RANK = dict(low=1, medium=2, high=3)
REVIEW_STATES = "approved auto_triaged pending rejected".split()

#: word of a title -> category, for ``workflow.episode_category``
TITLE_WORDS = {
    word: category
    for category, words in (
        ("cardiology", "statin lipid cholesterol hypertension heart afib"),
        ("endocrinology", "nutrition obesity thyroid diabetes"),
        ("nephrology", "dialysis renal kidney"),
        ("pulmonology", "asthma copd"),
        ("infectious disease", "vaccine antibiotic hiv sepsis"),
        ("neurology", "seizure migraine headache stroke"),
        ("hematology", "anticoagulation anemia"),
        ("oncology", "cancer"),
        ("preventive medicine", "screening"),
        ("rheumatology", "lupus arthritis gout"),
        ("dermatology", "psoriasis eczema rash"),
        ("psychiatry", "addiction anxiety depression"),
        ("geriatrics", "frailty dementia"),
        ("gastroenterology", "reflux ibd hepatitis liver"),
    )
    for word in words.split()
}

#: words of a heading that name no topic; a show's own recurring names are added by the caller
GENERIC_TOPICS = sorted("a few|bonus|clinical|key|quick|some|the|top".split("|"))
