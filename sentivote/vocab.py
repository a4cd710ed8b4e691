"""The fixed vocabulary every operator shares: categories, questions, models.

These are small, closed lists known before a job starts.  Operators turn them
into literal arrays, maps or column lists, so no plan joins or broadcasts them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Question:
    key: str
    tag: str  # ROI, NOT or OBL, as written in the questions file
    text: str

    @property
    def category(self) -> str:
        return TAG_CATEGORY[self.tag]


@dataclass(frozen=True)
class Model:
    name: str
    usd_in_per_m: str  # kept as text: becomes an exact decimal, not a double
    usd_out_per_m: str

    @property
    def short(self) -> str:
        return self.name.split("/")[-1][:20]


# --- fixed values: labels, priorities, prices, questions, prompts -----------
CATEGORIES = ["ROI", "Notoriete", "Obligation", "Description"]
PRIORITY = ["ROI", "Obligation", "Notoriete", "Description"]
TAG_CATEGORY = {"ROI": "ROI", "NOT": "Notoriete", "OBL": "Obligation"}
TAG_KEY = {"ROI": "roi", "NOT": "notoriete", "OBL": "obl"}

CATEGORY_ALIASES = {
    "ROI": "ROI",
    "NOTORIETE": "Notoriete",
    "NOTORIÉTÉ": "Notoriete",
    "OBLIGATION": "Obligation",
    "DESCRIPTION": "Description",
}
YES_WORDS = ["oui", "yes", "true", "1"]

MODELS = [
    Model("meta-llama/llama-3.3-70b-instruct", "0.10", "0.32"),
    Model("google/gemma-3-27b-it", "0.08", "0.16"),
    Model("mistralai/mistral-nemo", "0.02", "0.03"),
    Model("qwen/qwen3-8b", "0.05", "0.40"),
    Model("openai/gpt-4o-mini", "0.15", "0.60"),
]
DEFAULT_PRICE = ("0.10", "0.10")
USD_PER_EUR = 1.08

QUESTIONS = [
    Question("roi_1", "ROI", "La phrase évoque-t-elle un gain financier, une réduction de coût, ou une rentabilité mesurable ?"),
    Question("roi_2", "ROI", "Met-elle en avant une amélioration fonctionnelle claire (temps, charge, automatisation…), formulée comme un avantage opérationnel ?"),
    Question("roi_3", "ROI", "L’effet est-il formulé comme un impact sur les résultats, les ressources ou la performance d’une organisation ?"),
    Question("notoriete_1", "NOT", "La phrase valorise-t-elle une amélioration du bien-être, du confort, de la qualité de vie ou du cadre de travail d’un usager (interne ou externe) ?"),
    Question("notoriete_2", "NOT", "Met-elle en avant un label, une reconnaissance, une attractivité, ou une image positive d’un service, d’un lieu ou de l’organisation ?"),
    Question("notoriete_3", "NOT", "Suggère-t-elle un impact visible, tangible, ou perçu positivement dans l’environnement, les usages ou l’expérience utilisateur ?"),
    Question("obl_1", "OBL", "La phrase évoque-t-elle une nécessité de respecter une norme, une loi ou une exigence réglementaire ?"),
    Question("obl_2", "OBL", "Fait-elle référence à une mesure de sécurité ou de prévention des risques (physiques, numériques, juridiques…) ?"),
    Question("obl_3", "OBL", "Présente-t-elle une action formulée comme nécessaire pour éviter un danger, une sanction, ou pour garantir une protection minimale ?"),
]

PHRASE_PROMPT = (
    'Phrase : "{phrase}"\n\n'
    "Question : {question_text}\n\n"
    "Réponds UNIQUEMENT avec ce JSON valide (sans markdown) :\n"
    '{{"reponse": "oui"}} ou {{"reponse": "non"}}'
)
PARAGRAPH_PROMPT = (
    "Paragraphe de contexte :\n"
    '"""{full_paragraph}"""\n\n'
    'Phrase à analyser : "{phrase}"\n\n'
    "Question : {question_text}\n\n"
    "Réponds UNIQUEMENT avec ce JSON valide (sans markdown) :\n"
    '{{"reponse": "oui"}} ou {{"reponse": "non"}}'
)

_LLAMA70 = "meta-llama/llama-3.3-70b-instruct"
_GEMMA27 = "google/gemma-3-27b-it"
_NEMO = "mistralai/mistral-nemo"
_QWEN8 = "qwen/qwen3-8b"
_DEEPSEEK = "deepseek/deepseek-r1-0528"
_PHI4 = "microsoft/phi-4"
_LLAMA8 = "meta-llama/llama-3.1-8b-instruct"
_MISTRAL7 = "mistralai/mistral-7b-instruct"

REFERENCE_ENSEMBLE = "A_reference"
ENSEMBLES = {
    "A_reference": [_LLAMA70, _GEMMA27, _NEMO, _QWEN8, _DEEPSEEK],
    "B_sans_qwen": [_LLAMA70, _GEMMA27, _NEMO, _PHI4, _DEEPSEEK],
    "C_sans_mistral_nemo": [_LLAMA70, _GEMMA27, _MISTRAL7, _QWEN8, _DEEPSEEK],
    "D_sans_deepseek": [_LLAMA70, _GEMMA27, _NEMO, _QWEN8, _LLAMA8],
    "E_sans_qwen_mistral": [_LLAMA70, _GEMMA27, _LLAMA8, _PHI4, _DEEPSEEK],
    "F_3_suppressions": [_LLAMA70, _GEMMA27],
}
QUESTION_LABELS = {
    "roi_1": "ROI-1 : Gain financier",
    "roi_2": "ROI-2 : Amélioration fonctionnelle",
    "roi_3": "ROI-3 : Impact performance org.",
    "notoriete_1": "NOT-1 : Bien-être usager",
    "notoriete_2": "NOT-2 : Label/image positive",
    "notoriete_3": "NOT-3 : Impact perçu positif",
    "obl_1": "OBL-1 : Norme/loi/réglementation",
    "obl_2": "OBL-2 : Sécurité/prévention risques",
    "obl_3": "OBL-3 : Eviter danger/sanction",
}
# --- end of fixed values -----------------------------------------------------

QUESTION_KEYS = [q.key for q in QUESTIONS]

# A phrase is identified by all three columns; the folder is part of the key so
# that equal file names in two client folders never collide.
PHRASE_KEY = ["source_folder", "source_file", "phrase_index"]
SEGMENT_KEY = ["source_folder", "source_file", "paragraph_index"]
FILE_KEY = ["source_folder", "source_file"]
