"""Patterns, word lists, thresholds and formats that results depend on, given as they must be.

Patterns are written for Unicode-aware matching; :func:`lexloom.functions.text.rx` adds Java's flags.
"""

LETTERS = "A-Za-záéíóúüñÁÉÍÓÚÜÑ"
LOWER_LETTERS = "a-záéíóúüñ"
UPPER_LETTERS = "A-ZÁÉÍÓÚÜÑ"

# --- Character corrections, applied in this order.
OCR_CORRECTIONS = (
    (r"ci6nes\b", "ciones"),
    (r"ci6n\b", "ción"),
    (r"([A-Za-záéíóúüñÁÉÍÓÚÜÑ])6n\b", "$1ón"),
    (r"([A-Za-záéíóúüñÁÉÍÓÚÜÑ])6s\b", "$1ós"),
    (r"([a-záéíóúüñ])6(?=[a-záéíóúüñ])", "$1ó"),
    (r"\b0([a-záéíóúüñ])", "o$1"),
    (r"([a-záéíóúüñ])0\b", "$1o"),
    (r"\bl([0O])s\b", "los"),
    (r"\bd([0O])s\b", "dos"),
    (r"(?i)\bpr([0O])ceso\b", "proceso"),
    (r"(?i)\bc([0O])nsejo\b", "consejo"),
)

# --- Line filters.
MARKDOWN_STRUCTURE = r"^\s*(#{1,6}\s|[-*|!]|\d+\.|---)"
INSTITUTIONAL_NOISE = (
    r"(?i)^(\d{7,}\s*\S{0,30}$|[A-Za-z]*@\S+$|[XxYy][\s@]?\S{0,30}$"
    r"|(?:YouTube|YeuTube|Facebook|Instagram|Twitter)\b.*$|[a-z]\d{2}[a-z]\w{0,30}$)"
)
NOISE_RATIO = 0.45
FRONT_JUNK = r"^(\d{7,}|[A-Z@#·\s\-\.\d]{3,50}$|.{0,5}$|.*[@#].*)"
FRONT_LETTER_RATIO = 0.5
CONNECTORS = (
    "que para por con sin como según entre sobre bajo durante mediante desde hasta siendo puede debe tiene está fue "
    "han será son del los las una uno este esta"
).split()
LEGEND_LINE_LENGTH, LEGEND_LINES, LEGEND_SHARE = 35, 3, 0.6

# --- Footnote numbers.
CITATION_WORDS = "ley artículo articulo decreto numeral inciso parágrafo paragrafo literal ordinal resolución resolucion".split()
FOOTNOTE_LOOKBACK, FOOTNOTE_MOST = 40, 55

# --- Internal references: (pattern, points, on the stripped line, below this length).
REFERENCE_RULES = (
    (r"(?i)^\s*\d{0,2}\s*ver\s+p[aá]gs?\.?\s*\d", 3, False, None),
    (r"(?i)^\s*\d{0,2}\s*ver\s+pdf\b", 3, False, None),
    (r"(?i)\bver\s+pdf\s*:?\s*\d+\b", 3, False, None),
    (r"(?i)\bver\s+folio\b", 3, False, None),
    (r"^\s*\d{1,2}\s{2,}[A-ZÁÉÍÓÚÜÑ]", 3, True, None),
    (r"^\s*\d{1,2}\s{2,}[a-záéíóúüñ]", 3, True, None),
    (r"(?i)^\s*folio[s]?\s+\d+", 2, False, None),
    (r"(?i)^\s*cuaderno\s+\d+", 2, False, None),
    (r"(?i)\barchivo\s+\S+\.pdf\b", 2, False, None),
    (r"(?i)^\s*expediente\s+n[°º]?\s*\d", 2, False, None),
    (r"https?://", 2, False, None),
    (r"(?i)onedrive|sharepoint|drive\.google", 2, False, None),
    (r"(?i)\bpdf\s+\d{2}\s+del\s+expediente\b", 2, False, None),
    (r"(?i)\bexpediente\s+electrónico\s+judicial\b", 2, False, None),
    (r"(?i)^\s*\d{1,2}\s+en adelante\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+al respecto\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+m\.p\.\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+(corte constitucional|consejo de estado|sección primera|sala plena|sala de lo contencioso)\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+en cumplimiento\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+vale la pena\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+presentación de la demanda\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+[A-Za-z]{1,3}-\d{3,}\b", 3, False, None),
    (r"(?i)^\s*\d{1,2}\s+por (el|la|lo) cual\b", 3, False, None),
    (r"^\s*\d{1,2}\s*['‘’“”]?\s*$", 3, True, None),
    (r"(?i)^\s*\d{0,2}\s*(radicaci[oó]n|demandante|demandados?|ponente|magistrad[oa]|secretari[oa])\s*:", 3, True, 120),
    (r"(?i)^por\s+medio\s+del\s+cual\s+se\b", 3, True, 120),
    (r"(?i)^\s*p[aá]g\.?\s*\d+\s*$", 1, False, None),
    (r"(?i)^\s*ver\s+considerando\b", 1, False, None),
)
REFERENCE_SHORT_LINE, REFERENCE_THRESHOLD = 80, 3
PAGE_LEAD = r"(?im)^\s*p[aá]g\.?\s*\d+\s+([a-záéíóúüñ])"

# --- Citation blocks.
CITATION_ANCHOR = (
    r"(?i)(Radicaci[oó]n:\s*\d{2,}|Referencia:\s*medio\s+de\s+control"
    r"|[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+\s+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+\s+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+\.\s+Bogot[aá])"
)
CITATION_FRAGMENT = (
    r"(?i)^(\d{5}-\d+\.\s*Demandante:|General\s+de\b|Delegad[oa]\s+para\b|la\s+Naci[oó]n$|Procuradur[ií]a$"
    r"|Nacional\s+de\s+Licencias\b|-$|Ambientales\s+y\s+Agrarios|Asuntos$|Naci[oó]n\s*-\s*Ministerio\b"
    r"|.*-\s*ANLA\b|.*-\s*otros\.\s*$)"
)
CITATION_REACH, CITATION_SHORT = 19, 70

# --- Line and paragraph merging.
ENUMERATION = r"^(\d{1,3}\.\s|[a-z]\)\s|[ivxIVX]+\.\s|[A-Z]\.\s|\([a-z]\)\s|\(\d+\)\s|(?:PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO)[\.:]\s*)"
DECISION_START = r"(?i)^(RESUELVE|FALLA|DECIDE|SE RESUELVE|POR LO EXPUESTO|EN MÉRITO DE LO EXPUESTO|EN MERITO DE LO EXPUESTO)\b"
DANGLING_TAIL = (
    r"(?i)\b(y|e|o|u|que|de|del|la|el|los|las|en|con|por|para|su|sus|una|un|al|como|sin|ni|sobre|bajo|ante|entre|desde"
    r"|hasta|dicha|dicho|dichas|dichos|cuyo|cuya|cuyos|cuyas|esta|este|estos|estas|aquel|aquella|todo|toda|cada|ser"
    r"|siendo|ha|han|fue|ser[aá]|deber[aá]|podr[aá])\s*$"
)

# --- Pages and furniture.
PAGE_MARK = r"(?i)\n(?=(?:pág\.?\s*\d+|página\s*\d+|---+\s*\d+))"
PAGE_COUNT = r"(?i)(pág\.?\s*\d+|página\s*\d+|\bpage\s*\d+)"
PAGE_CHARS = 3000
FURNITURE_SHARE = 0.60

# --- Headings.
HEADING_BODY = (
    r"^(#{1,6}\s+(?:[IVXivx]+\.|\d+(?:\.\d+)*\.?)?\s*[A-ZÁÉÍÓÚÜÑ][^.]*?\.)\s+"
    r"([A-ZÁÉÍÓÚÜÑ][A-Za-záéíóúüñÁÉÍÓÚÜÑ\s,()]{10,}.*)$"
)
HEADING_REACH = 15
LEADING_ENUMERATION = r"(?i)^(?:[IVXLCDM]+|\d+(?:\.\d+)*)(?=[.):\-\s]|$)[.):\-\s]*"
SECTION_NAMES = {1: "Contexto del caso", 2: "Desarrollo procesal", 3: "Análisis del tribunal", 4: "Decisión"}
SECTION_VARIANTS = {
    1: ("antecedentes", "sintesis del caso", "resumen de la demanda", "petitum", "causa petendi"),
    2: (
        "contestacion de la demanda",
        "actuacion procesal",
        "actuaciones posteriores al fallo",
        "tramite de la accion",
        "tramite de la segunda instancia",
        "tramite de segunda instancia",
        "sentencia de primera instancia",
        "fallo de primera instancia",
        "el recurso de apelacion",
        "recurso de apelacion",
        "alegatos de conclusion",
        "trámite de la accion",
    ),
    3: ("consideraciones de la sala", "consideraciones del tribunal", "consideraciones"),
    4: ("conclusiones", "decision", "falla", "resuelve"),
}

# --- Profiling.
LEGAL_CITATIONS = (
    r"(?i)\b(ley|decreto|artículo|articulo|sentencia|expediente)\s*\d",
    r"(?i)\b(c\.p\.|c\.c\.|c\.p\.c\.|c\.g\.p\.)\b",
    r"(?i)\bcorte\s+(constitucional|suprema)\b",
    r"(?i)\bconsejo\s+de\s+estado\b",
    r"(?i)\b[TSC]-\d{3,}\b",
    r"(?i)\bresolución\s*n?[°º]?\s*\d",
)
OCR_NOISE = (r"[^\w\s]{3,}", r"\d[a-z]\d", r"[a-z]\d[a-z]", r"[\x00-\x1f]", r"[ﬁﬂ]")
FOOTNOTE_STARTS = (r"^\s*\d{1,2}\s+[A-Z]", r"^\s*\[\d+\]", r"^\s*\(\d+\)", r"(?i)^\s*\d{1,2}\s+(ver|véase|cf\.|vid\.)\b")
OCR_NOISE_THRESHOLD = 0.05
COASTAL_TERMS = (
    "playa", "playas", "bahía", "bahia", "bajamar", "litoral", "erosión", "erosion", "ocupación", "ocupacion",
    "espacio público", "espacio publico", "dimar", "concesión marítima", "concesion maritima",
    "bienes de uso público", "bienes de uso publico", "recuperación costera", "recuperacion costera", "servidumbre",
    "protección litoral", "proteccion litoral", "zona costera", "franja de playa", "línea de costa",
    "linea de costa", "pleamar", "marea", "puerto", "muelle", "embarcadero", "zona de bajamar",
    "terrenos de bajamar", "bien público", "bien publico", "dominio público", "dominio publico", "restinga",
    "manglar", "estuario", "acantilado", "vertimiento", "vertimientos", "aguas residuales", "emisario submarino",
    "emisario", "arrecife", "arrecifes", "coral", "corales", "colector pluvial", "colector",
    "contaminación marina", "contaminacion marina", "pradera marina", "praderas marinas", "pastos marinos",
    "capitanía de puerto", "corpamag",
)

# --- Paragraph classes, in the order that breaks ties; patterns see the lower-cased paragraph.
SECTION_PATTERNS = {
    "metadata": (
        r"^(república|republica|tribunal|juzgado|sala|radicación|radicacion|expediente)",
        r"^(magistrado|magistrada|ponente|secretario|secretaria)",
        r"^(demandante|demandado|actor|accionante|accionado)",
    ),
    "facts": (
        r"\b(hechos|antecedentes|síntesis|sintesis|resumen)\b",
        r"\b(situación fáctica|situacion factica|contexto)\b",
    ),
    "claims": (
        r"\b(pretensión|pretension|pretensiones|solicita|solicitud)\b",
        r"\b(pide|petición|peticion|demanda)\b",
    ),
    "legal_basis": (
        r"\b(ley|decreto|artículo|articulo|constitución|constitucion)\b",
        r"\b(norma|código|codigo|reglamento|resolución|resolucion)\b",
        r"\b(fundamento|fundamentos|marco jurídico|marco juridico)\b",
    ),
    "evidence": (
        r"\b(prueba|pruebas|peritaje|dictamen|testimonio)\b",
        r"\b(documento|documentos|acervo probatorio)\b",
        r"\b(inspección|inspeccion|reconocimiento)\b",
    ),
    "analysis": (
        r"\b(considera|considerando|consideraciones|análisis|analisis)\b",
        r"\b(problema jurídico|problema juridico|estudio|valoración|valoracion)\b",
    ),
    "decision": (
        r"\b(resuelve|falla|decide|niega|concede|ordena)\b",
        r"\b(declara|condena|absuelve|accede|deniega)\b",
    ),
    "citations": (
        r"\b(sentencia\s+[tc]-\d+|corte\s+constitucional)\b",
        r"\b(consejo\s+de\s+estado|jurisprudencia)\b",
    ),
}
METADATA_STARTS = ("República", "REPÚBLICA", "Tribunal", "TRIBUNAL", "Juzgado", "JUZGADO")
METADATA_BONUS, FULL_SCORE = 2, 5.0

# --- Entities: alternatives in matching order.
ENTITY_TERMS = {
    "playa": "playa|playas",
    "bahia": "bahía|bahia|bahías|bahias",
    "bajamar": "bajamar|zona de bajamar|terrenos de bajamar",
    "litoral": "litoral|línea de costa|linea de costa|zona costera",
    "erosion": "erosión|erosion|erosión costera|erosion costera",
    "ocupacion": "ocupación|ocupacion|ocupación indebida|ocupacion indebida",
    "espacio_publico": "espacio público|espacio publico|bien público|bien publico",
    "dimar": "dimar|dirección general marítima|direccion general maritima",
    "concesion_maritima": "concesión marítima|concesion maritima|permiso marítimo|permiso maritimo",
    "bienes_uso_publico": "bienes de uso público|bienes de uso publico|dominio público|dominio publico",
    "recuperacion_costera": "recuperación costera|recuperacion costera|restauración costera|restauracion costera",
    "servidumbre": "servidumbre|servidumbre de tránsito|servidumbre de transito",
    "proteccion_litoral": "protección litoral|proteccion litoral|protección costera|proteccion costera",
    "pleamar": "pleamar|marea alta|nivel de pleamar",
    "manglar": "manglar|manglares|zona de manglar",
    "puerto": "puerto|muelle|embarcadero|terminal portuario|terminal portuaria",
    "estuario": "estuario|estuarios|desembocadura",
    "restinga": "restinga|restingas",
    "acantilado": "acantilado|acantilados|risco|riscos",
    "vertimiento": "vertimiento|vertimientos|aguas residuales|aguas servidas",
    "emisario": "emisario submarino|emisario|emisarios",
    "arrecife": "arrecife|arrecifes|formación arrecifal|formacion arrecifal|coral|corales",
    "colector_pluvial": "colector pluvial|colector|colectores|sistema de drenaje pluvial",
    "contaminacion_marina": "contaminación marina|contaminacion marina|contaminación del mar|contaminacion del mar|contaminación costera",
    "pradera_marina": "pradera marina|praderas marinas|pastos marinos|algas marinas",
    "capitania": "capitanía de puerto|capitania de puerto|capitanía",
    "corpamag": "corpamag|corporación autónoma regional del magdalena|corporacion autonoma regional del magdalena",
}
KEY_ENTITIES = ("dimar", "playa", "bajamar", "ocupacion", "espacio_publico")

# --- Quality weights.
QUALITY_WEIGHTS = {"paragraph": 0.20, "footer": 0.15, "ocr": 0.15, "citation": 0.10, "segmentation": 0.20, "entity": 0.20}

# --- Images.
IMAGE_SIDE, IMAGE_VARIANCE, IMAGE_CONTEXT = 350, 100.0, 300
IMAGE_FREE_AREA, IMAGE_FALLBACK_AREA, IMAGE_FALLBACK_KEEP = 250_000, 160_000, 2
IMAGE_CONTEXT_WORDS = (
    r"(?i)\b(figura|tabla|imagen|gráfico|grafico|ilustración|ilustracion|foto|fotografía|fotografia|esquema|diagrama"
    r"|mapa|mapas|plano|planos|croquis|anexo|anexos|cronograma|fase|fases)\b"
)

# --- Chunking, index and retrieval.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_SEPARATORS = 1000, 200, ("\n\n", "\n", ".", " ", "")
INDEX_BATCH = 500
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_C, BM25_WEIGHT, VECTOR_WEIGHT = 160, 0.3, 0.7
RERANK_CHARS, RERANK_LEAST, RERANK_MOST = 1500, 0.0, 10.0
PREVIEW_CHARS = 500
CALLS_PER_MINUTE = 9
#: A judge rests 9 seconds between calls; this is the whole number of calls a minute that keeps to it.
JUDGE_CALLS_PER_MINUTE = 6

# --- Answers and context.
NO_ANSWER = "No se encontraron fragmentos relevantes en la base de conocimiento."
UNKNOWN_SOURCE = "desconocido"
CONTEXT_LINES = (
    ("Corporación", ("Corporación", "CorporaciÃ³n", "Corporacion")),
    ("Magistrado ponente", ("Magistrado ponente",)),
    ("Tema principal", ("Tema principal",)),
    ("Sección", ("section_name",)),
    ("Resumen", ("summary",)),
)

#: Numbers of footnotes after brackets, years and case numbers, in the order of their removal.
FOOTNOTE_NUMBERS = (
    (r"([)\]’”'\"])\s+\d{1,2}(\s|[.,;:!?\)\]]|$)", "$1$2", 2),
    (r"\b(1[89]\d\d|20\d\d)\d\b(?!\d)", "$1", 1),
    (rf"(\b(?:1[89]\d\d|20\d\d))\s+\d{{1,2}}(?=\s*[.,;:!?\)\]]|\s+[{LOWER_LETTERS}]|\s*$)", "$1", 1),
    (r"((?:^|[^\pL\pN_])[A-Z][\w-]*-\d{2,4})\s+\d{1,2}(\s|[.,;:!?\)\]]|$)", "$1$2", 2),
)

#: Page numbers inside running titles.
PAGE_NUMBERS = (r"(?i)\b(pág\.?|página|page)\s*\d+\b", r"\b\d{1,4}\s*$", r"^\s*\d{1,4}\s+")

#: Source notes at the end of an answer.
ANSWER_TAILS = (r"\s*\(fuente:[^)]+\)\s*$", r"\s*\((?:doc|chunk)[^)]*\)\s*$")
