"""Topics of several schemes mapped onto one vocabulary of fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields, by label; a field's slug is its label in lower case with hyphens.
LABELS = (
    "Agricultural and Biological Sciences", "Arts and Humanities", "Biochemistry, Genetics and Molecular Biology", "Business, Management and Accounting", "Chemical Engineering", "Chemistry",
    "Computer Science", "Decision Sciences", "Earth and Planetary Sciences", "Economics, Econometrics and Finance", "Energy", "Engineering", "Environmental Science", "Immunology and Microbiology",
    "Materials Science", "Mathematics", "Medicine", "Neuroscience", "Nursing", "Pharmacology, Toxicology and Pharmaceutics", "Physics and Astronomy", "Psychology", "Social Sciences", "Veterinary", "Dentistry", "Health Professions",
)
SLUGS = {label: label.lower().replace(",", "").replace(" ", "-") for label in LABELS}
#: The field of each arXiv archive.
ARXIV_ARCHIVES = {
    "astro-ph": "physics-and-astronomy",
    "cond-mat": "physics-and-astronomy",
    "cs": "computer-science",
    "econ": "economics-econometrics-and-finance",
    "eess": "engineering",
    "gr-qc": "physics-and-astronomy",
    "hep-ex": "physics-and-astronomy",
    "hep-lat": "physics-and-astronomy",
    "hep-ph": "physics-and-astronomy",
    "hep-th": "physics-and-astronomy",
    "math": "mathematics",
    "math-ph": "physics-and-astronomy",
    "nlin": "physics-and-astronomy",
    "nucl-ex": "physics-and-astronomy",
    "nucl-th": "physics-and-astronomy",
    "physics": "physics-and-astronomy",
    "q-bio": "agricultural-and-biological-sciences",
    "q-fin": "economics-econometrics-and-finance",
    "quant-ph": "physics-and-astronomy",
    "stat": "mathematics",
}
#: The field of each arXiv category that differs from its archive's.
ARXIV_CATEGORIES = {
    "cond-mat.mtrl-sci": "materials-science",
    "physics.ao-ph": "earth-and-planetary-sciences",
    "physics.chem-ph": "chemistry",
    "physics.geo-ph": "earth-and-planetary-sciences",
    "physics.med-ph": "medicine",
    "physics.soc-ph": "social-sciences",
    "q-bio.bm": "biochemistry-genetics-and-molecular-biology",
    "q-bio.cb": "biochemistry-genetics-and-molecular-biology",
    "q-bio.gn": "biochemistry-genetics-and-molecular-biology",
    "q-bio.mn": "biochemistry-genetics-and-molecular-biology",
    "q-bio.nc": "neuroscience",
    "q-bio.sc": "biochemistry-genetics-and-molecular-biology",
    "stat.ml": "computer-science",
}
#: The field of each preprint server category.
PREPRINT_CATEGORIES = {
    "addiction medicine": "medicine",
    "allergy and immunology": "immunology-and-microbiology",
    "anesthesia": "medicine",
    "animal behavior and cognition": "agricultural-and-biological-sciences",
    "biochemistry": "biochemistry-genetics-and-molecular-biology",
    "bioengineering": "engineering",
    "bioinformatics": "biochemistry-genetics-and-molecular-biology",
    "biophysics": "biochemistry-genetics-and-molecular-biology",
    "cancer biology": "biochemistry-genetics-and-molecular-biology",
    "cardiovascular medicine": "medicine",
    "cell biology": "biochemistry-genetics-and-molecular-biology",
    "clinical trials": "medicine",
    "dentistry and oral medicine": "dentistry",
    "dermatology": "medicine",
    "developmental biology": "biochemistry-genetics-and-molecular-biology",
    "ecology": "agricultural-and-biological-sciences",
    "emergency medicine": "medicine",
    "endocrinology": "medicine",
    "epidemiology": "medicine",
    "evolutionary biology": "agricultural-and-biological-sciences",
    "forensic medicine": "medicine",
    "gastroenterology": "medicine",
    "genetic and genomic medicine": "medicine",
    "genetics": "biochemistry-genetics-and-molecular-biology",
    "genomics": "biochemistry-genetics-and-molecular-biology",
    "geriatric medicine": "medicine",
    "health economics": "economics-econometrics-and-finance",
    "health informatics": "health-professions",
    "health policy": "medicine",
    "health systems and quality improvement": "health-professions",
    "hematology": "medicine",
    "hiv aids": "medicine",
    "immunology": "immunology-and-microbiology",
    "infectious diseases": "medicine",
    "intensive care and critical care medicine": "medicine",
    "medical education": "medicine",
    "medical ethics": "medicine",
    "microbiology": "immunology-and-microbiology",
    "molecular biology": "biochemistry-genetics-and-molecular-biology",
    "nephrology": "medicine",
    "neurology": "medicine",
    "neuroscience": "neuroscience",
    "nursing": "nursing",
    "nutrition": "medicine",
    "obstetrics and gynecology": "medicine",
    "occupational and environmental health": "medicine",
    "oncology": "medicine",
    "ophthalmology": "medicine",
    "orthopedics": "medicine",
    "otolaryngology": "medicine",
    "pain medicine": "medicine",
    "paleontology": "earth-and-planetary-sciences",
    "palliative medicine": "medicine",
    "pathology": "medicine",
    "pediatrics": "medicine",
    "pharmacology and therapeutics": "pharmacology-toxicology-and-pharmaceutics",
    "pharmacology and toxicology": "pharmacology-toxicology-and-pharmaceutics",
    "physiology": "biochemistry-genetics-and-molecular-biology",
    "plant biology": "agricultural-and-biological-sciences",
    "primary care research": "medicine",
    "psychiatry and clinical psychology": "medicine",
    "public and global health": "medicine",
    "radiology and imaging": "medicine",
    "rehabilitation medicine and physical therapy": "health-professions",
    "respiratory medicine": "medicine",
    "rheumatology": "medicine",
    "scientific communication and education": "social-sciences",
    "sexual and reproductive health": "medicine",
    "sports medicine": "medicine",
    "surgery": "medicine",
    "synthetic biology": "biochemistry-genetics-and-molecular-biology",
    "systems biology": "biochemistry-genetics-and-molecular-biology",
    "toxicology": "pharmacology-toxicology-and-pharmaceutics",
    "transplantation": "medicine",
    "urology": "medicine",
    "zoology": "agricultural-and-biological-sciences",
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def field_of(scheme: Column, value: Column) -> Column:
    """The field of one topic: an aggregator's by its field label, arXiv's by category, then archive, a preprint server's by name."""
    low = F.lower(F.trim(value))
    arxiv = F.coalesce(_lookup(ARXIV_CATEGORIES)[low], _lookup(ARXIV_ARCHIVES)[F.split(low, r"\.")[0]])
    labels = _lookup({k.lower(): v for k, v in SLUGS.items()})[low]
    return F.when(scheme == "openalex", labels).when(scheme == "arxiv", arxiv).when(scheme == "biorxiv", _lookup(PREPRINT_CATEGORIES)[low])


def fields_of(topics: Column) -> Column:
    """array<struct<scheme, value>> -> sorted distinct fields."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(topics, lambda t: field_of(t.scheme, t.value)))))


def unmapped(topics: Column) -> Column:
    """Topics of known schemes that have a value but no field, each once, in the order they first occur."""
    return F.array_distinct(F.filter(topics, lambda t: t.scheme.isNotNull() & (F.length(F.trim(t.value)) > 0) & field_of(t.scheme, t.value).isNull()))


def known_fields(slugs: list[str]) -> list[str]:
    """The slugs, once each; an unknown one is an error."""
    wrong = sorted(set(slugs) - set(SLUGS.values()))
    if wrong:
        raise ValueError(f"unknown fields: {wrong}")
    return list(dict.fromkeys(slugs))
