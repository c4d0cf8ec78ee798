"""Limits, patterns, word lists and templates that decide results.

Patterns are written for Java's regex engine. ``W`` is the word-character class and
``S`` the whitespace class, both spelled out so that no engine-dependent shorthand is
involved.
"""

# ---- character classes (fixed values) -------------------------------------------------
W = r"[\p{L}\p{N}_]"
# Blanks beyond Latin-1 sit behind one range test, so that ordinary letters fail at once.
_FAR_BLANKS = (
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
S = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0{_FAR_BLANKS}]"
NOT_S = rf"[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0{_FAR_BLANKS}]"
S_BUT_NEWLINE = rf"[\t\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0{_FAR_BLANKS}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"

# ---- token counting (fixed values) ----------------------------------------------------
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
MAX_CHUNK_TOKENS = 256
SOFT_TOKENS = 1024
HARD_TOKENS = 1600
MODEL_MAX_TOKENS = 2048
SAFE_TOKENS = 1800
TOKEN_THRESHOLDS = (256, 384, 512, 768, 1024, 1280, 1536, 1800, 2048)
TOKEN_PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
RECOMMENDED_LIMITS = (512, 768, 1024, 1280)
RECOMMENDED_FALLBACK = 1536

# ---- markdown structure (fixed values) ------------------------------------------------
FULL_DOCUMENT = "_full_document"
PAGE_MARKER = rf"(?i)<!--{S}*page:{S}*([0-9]+){S}*-->"
PAGE_MARKER_FORMAT = "<!-- page: %d -->"
CHAPTER = rf"(?iu)^{S}*(?:#{{1,6}}{S}*)?CHAPITRE{S}+([0-9]+(?:\.[0-9]+)*)(?:{S}*[-–—:.)]?{S}*(.*))?{S}*$"
HEADING = rf"^{S}*(#{{1,6}}){S}+(.+?){S}*$"
CHAPTER_ONE = rf"(?iu)^{S}*(?:#{{1,6}}{S}*)?CHAPITRE{S}+1(?!{W})"
INTRODUCTION = rf"(?iu)^{S}*(?:#{{1,6}}{S}*)?1\.1{S}+INTRODUCTION(?!{W})"
BOILERPLATE = (
    rf"(?iu)Conform[ée]ment{S}+à{S}+l['’]article{S}+2111-9{S}+du{S}+code{S}+des{S}+transports"
)
ANCHOR_WINDOW = 15
CHAPTER_TITLE_PREFIX = "CHAPITRE "
ANNEX_TITLE_PREFIX = "ANNEXE "

# ---- layout labels (fixed values) -----------------------------------------------------
LABEL_TABLE = "table"
LABEL_SECTION_HEADER = "section_header"
HEADING_LABEL_PARTS = ("heading", "title")

# ---- retrieval (fixed values) ---------------------------------------------------------
VECTOR_SIZE = 1024
K_VALUES = (1, 3, 5, 10)
RETRIEVE_K = 30
HYBRID_K = 20
HYBRID_TOP_K = 5
RERANK_BATCH = 4
RERANK_TASK = "Given a question query, retrieve relevant passages that answer the query"
RERANK_PROMPT = "<Instruct>: %s\n<Query>: %s\n<Document>: %s"

# Published defaults of the BM25 formula and of reciprocal-rank fusion.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60

# ---- question generation (fixed values) -----------------------------------------------
# A leading (?=[...]) names the characters a match can start with; it only saves time.
UNIT_SPLIT = rf"(?<=[.!?]){S}+|\n+"
UNIT_MIN_CHARS = 12
UNIT_JUNK = rf"^(?:[\p{{Nd}}./>-]|{S})+$"
SUPPORT_MAX_CHARS = 600
ANSWER_MAX_CHARS = 180
TARGET_PER_DOCUMENT = 500
ADVERSARIAL_SHARE = 0.05

DEFINITION_VERBS = (
    rf"(?=[cdes])(?<!{W})(?:est|sont|désigne|design[eé]|signifie|correspond à|constitue|se définit)(?!{W})"
)
LEGAL_REFERENCE = (
    rf"(?=[AaDdLlRr])(?iu)(?:article{S}+(?:L\.?|R\.?|D\.?|2111-9|8\.1){S}*[\p{{L}}\p{{N}}_.-]+"
    rf"(?:{S}+du{S}+code{S}+des{S}+transports)?"
    rf"|décret{S}+n[°º]?{S}*[\p{{L}}\p{{N}}_.-]+(?:{S}+du{S}+[^,;.]+)?"
    rf"|loi{S}+n[°º]?{S}*[\p{{L}}\p{{N}}_.-]+(?:{S}+du{S}+[^,;.]+)?"
    rf"|directive{S}+(?:européenne{S}+)?[\p{{L}}\p{{N}}_/.-]+"
    rf"|règlement{S}+(?:UE|européen)[\p{{L}}\p{{N}}_/() .-]*)"
)
QUANTITY = (
    rf"(?=[\p{{Nd}}Jj])(?iu)(?:(?<!{W})\p{{Nd}}+(?:[,.]\p{{Nd}}+)?{S}*(?:[€%](?={W})"
    rf"|(?:euros?|ans?|mois|jours?|heures?|minutes?|km|m|trains?|fois|personnes?|pages?)(?!{W}))"
    rf"|(?<!{W})J[- ]\p{{Nd}}+(?!{W})"
    rf"|(?<!{W})\p{{Nd}}{{1,2}}[h:]\p{{Nd}}{{2}}(?!{W})"
    rf"|(?<!{W})\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}(?!{W})"
    rf"|(?<!{W})\p{{Nd}}{{4}}(?!{W}))"
)
BARE_YEAR = r"^\p{Nd}{4}$"
DEADLINE = (
    r"(?=[AaÀàDdHhJj\p{Nd}])(?iu)(?:avant le|au plus tard|à compter du|jusqu'au|date limite|délai|horaire"
    r"|heures? de service|J[- ]\p{Nd}+|\p{Nd}{1,2}[h:]\p{Nd}{2}"
    r"|\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{2,4})"
)
ENUMERATOR = rf"^(?:\p{{Nd}}+[°.)]|[a-e][).]|[-–•]){S}*"
ACTION_VERBS = (
    rf"(?=[acdopté])(?<!{W})(?:doit|peut|adresse|transmet|dépose|procédure|étape|demande|organise|coordonne)(?!{W})"
)
ACTORS = (
    rf"(?=[AaCcEeGgSsÉéſ])(?iu)(?<!{W})(?:SNCF Réseau|ART|candidat|entreprise ferroviaire"
    rf"|gestionnaire d.infrastructure|État|AOT|AOM)(?!{W})"
)
ROLE_VERBS = (
    rf"(?=[acdegiopr])(?<!{W})(?:doit|assure|est|organise|coordonne|responsable|incombe|peut|adresse|reçoit|gère)(?!{W})"
)

TYPE_STRUCTURE = "locational/structural"
TYPE_DEFINITION = "factual/definition"
TYPE_LEGAL = "legal reference lookup"
TYPE_QUANTITY = "numeric/quantitative"
TYPE_DEADLINE = "temporal/deadline"
TYPE_PROCEDURE = "procedural"
TYPE_ROLE = "entity/role"
TYPE_UNANSWERABLE = "unanswerable"

QUESTION_STRUCTURE = "Quelle section du DRR traite ce sujet ?"
QUESTION_DEFINITION = "Que définit ou précise le document dans cet extrait ?"
QUESTION_LEGAL = "Quelle référence juridique est citée dans cet extrait ?"
QUESTION_QUANTITY = "Quelle valeur chiffrée est indiquée dans cet extrait ?"
QUESTION_DEADLINE = "Quelle échéance ou indication temporelle ressort de cet extrait ?"
QUESTION_PROCEDURE = "Quelle action ou procédure est décrite dans cet extrait ?"
QUESTION_ROLE = "Quel acteur ou quelle entité joue le rôle indiqué dans cet extrait ?"
QUESTION_FALLBACK = "Que précise le document dans cet extrait ?"

ADVERSARIAL_QUESTIONS = (
    "Quel est le numéro de téléphone direct du responsable de ce service ?",
    "Quelle est la couleur du formulaire utilisé pour cette démarche ?",
    "Quel est le mot de passe de la plateforme mentionnée dans ce passage ?",
    "Quelle est la date exacte de naissance du directeur cité dans ce passage ?",
    "Quel est le montant de la prime individuelle versée à cet acteur ?",
)
ADVERSARIAL_ANSWER = "Information non disponible dans le document"
ADVERSARIAL_STRIDE = 37
ADVERSARIAL_OFFSET = 11

# ---- question rewriting (fixed values) ------------------------------------------------
TOPIC_NUMBERING = rf"^(?:\p{{Nd}}+\.)+\p{{Nd}}*{S}*"
TOPIC_BULLET = rf"^[●\x{{f0b7}}]{S}*"
TOPIC_ARTICLES = ("le ", "la ", "les ", "l'", "un ", "une ", "des ", "de ")
TOPIC_VOWELS = ("a", "e", "i", "o", "u", "y", "é", "è", "ê", "à", "â")
QUOTED_TITLE = rf"«{S}*(.*?){S}*»"
REWRITE_LIMIT = 250
DEFAULT_QUESTION_TYPE = "factual"
REWRITE_TEMPLATES = {
    "definition": "Comment définit-on %s ?",
    "process": "Quelle est la procédure concernant %s ?",
    "obligation": "Quelles sont les obligations liées à %s ?",
    "deadline": "Quels sont les délais ou moments clés pour %s ?",
    "amount": "Quels sont les montants ou chiffres clés pour %s ?",
    "condition": "Sous quelles conditions s'applique %s ?",
    "actor": "Qui est responsable de %s ?",
    "contact": "Qui doit-on contacter pour %s ?",
    "system": "Comment fonctionne %s ?",
    "factual": "Que faut-il savoir sur %s ?",
    "list": "Quels sont les éléments inclus dans %s ?",
    "table": "Quelles données trouve-t-on concernant %s ?",
    "section": "Que contient la partie sur %s ?",
    "multi_chunk": "Quelles sont les informations croisées sur %s ?",
}
REWRITE_DEFAULT = "Pouvez-vous m'en dire plus sur %s ?"
