"""Word lists, phrase lists, patterns and limits."""

# Words that carry no topic.
STOP_WORDS = """a al algo algunas algunos ante antes como con contra cual cuando de del desde donde dos el la los las un una
unos unas y o u e en entre era erais eran es esa ese eso esta este esto estos estas fue fueron ha han hasta hay la le les
lo mas más me mi mucho muy no nos o os otra otro para pero poco por porque que quien se sea ser si sin sobre solo son su
sus también tanto te tiene tienen todo todos tras un una uno y ya cual cuales the of and to in is it that this for on as
with be by an are from at or was were which not but have has""".split()

# Question words that aren't topics.
QUESTION_WORDS = """que cual cuales como donde cuando quien quienes cuanto cuantos cuanta cuantas porque para dice dicen
sobre acerca segun curso material materiales lectura lecturas texto textos autor autores explica explicar resume resumir
significa significo hay tiene puede debe seria fueron""".split()

# Phrases that tell what a question asks for.
CAUSAL = [
    "por que", "porque", "causa", "causas", "origen", "origino", "debido", "explica", "explicar", "razon", "razones",
    "consecuencia", "consecuencias", "influyo", "provoco", "genero", "llevo a", "resulto",
]
COMPARING = [
    "compara", "comparar", "diferencia", "diferencias", "frente a", "versus", "contraste", "contrastar", "distingue",
    "mientras que", "en cambio", "desacuerdo", "discrepan", "ambos", "las dos", "los dos",
]
BROAD = [
    "resume", "resumir", "resumen", "panorama", "vision general", "que cubre", "que se ve", "temas de", "sintesis",
    "repasar", "todo lo que",
]
NARROW = [
    "cuando", "que dia", "que fecha", "cuanto", "cuantos", "cuantas", "quien", "quienes", "donde", "cual es la fecha",
    "a que hora",
]
ADMIN = [
    "examen", "parcial", "final", "nota", "notas", "calificacion", "entrega", "plazo", "cronograma", "silabo", "syllabus",
    "evaluacion", "rubrica", "peso", "asistencia", "horario", "clase", "sesion", "semana", "fecha", "creditos", "credito",
    "profesor", "docente", "seccion", "curso", "requisito", "requisitos", "bibliografia", "trabajo", "practica", "control",
    "lectura obligatoria", "sumilla", "competencias",
]
ADMIN_STRONG = [
    "examen", "parcial", "nota", "notas", "calificacion", "entrega", "plazo", "cronograma", "silabo", "evaluacion",
    "rubrica", "creditos", "credito", "profesor", "docente", "horario", "asistencia", "sumilla", "bibliografia",
    "requisito", "requisitos", "seccion", "evalua", "evaluar", "lecturas", "lectura", "unidad", "semana", "temas", "tema",
]
ADVICE = [
    "mejor manera", "como estudiar", "consejos", "recomiendas", "recomiendame", "tips", "como memorizar", "como aprender",
]
WANTS_ANSWERS = [
    "respuestas del examen", "respuestas de la evaluacion", "resuelve por mi", "resuelveme", "hazme el trabajo",
    "escribeme el ensayo", "dame las respuestas", "haz mi tarea", "resuelve el ejercicio por mi",
]
CAUSAL_MARKERS = [
    "causa", "causas", "causo", "provoco", "genero", "origino", "debido", "consecuencia", "consecuencias", "resulto",
    "produjo", "explica", "razon", "factor", "factores", "efecto", "efectos", "impacto", "llevo", "condujo", "derivo",
    "influyo", "determino", "por tanto", "asi", "mientras", "permitio", "favorecio", "agravo",
]

# How sentences begin that frame a debate, and markers of structured answers.
FRAMING = [
    "entiendo tu postura", "entiendo que", "reconstruyendo tu", "tu tesis", "tu postura", "tu afirmacion", "sostienes que",
    "al examinar la evidencia", "veamos que dice la evidencia", "como no has incluido", "no has incluido un intento",
    "para que puedas construir tu respuesta", "para dar el primer paso", "para construir tu propia respuesta",
    "como pista orientadora", "antes de responder, ", "tu intento no contiene", "tu intento esta vacio",
    "no has compartido un intento",
]
MARKERS = [
    "PREGUNTA:", "OPCION_A:", "OPCION_B:", "OPCION_C:", "OPCION_D:", "RESPUESTA_CORRECTA:", "EXPLICACION:",
    "TARJETA_PREGUNTA:", "TARJETA_RESPUESTA:",
]

# Traces of four operations in an answer, and phrases that hand out finished work.
TRACES = {
    "autoridad": [
        "silabo", "sílabo", "cronograma", "lectura académica", "lectura academica", "diapositiva", "clase",
        "fuente oficial", "normativ", "el profesor", "material del curso", "documento oficial",
    ],
    "desacuerdo": [
        "sin embargo", "en cambio", "discrepan", "debate", "controversia", "no hay consenso", "mientras que",
        "por su parte", "difieren", "tension", "tensión", "contrasta", "otros autores",
    ],
    "construccion_dato": [
        "estimacion", "estimación", "estiman", "cifras varían", "cifras varian", "metodolog", "supuesto", "censo",
        "aproximad", "se calcula", "discutid", "depende de",
    ],
    "posicion": [
        "desde", "parte de", "su enfoque", "perspectiva", "sostiene", "argumenta", "plantea", "para el autor",
        "según el autor", "segun el autor",
    ],
}
HANDS_OUT = [
    "la respuesta correcta es", "aquí está tu ensayo", "aqui esta tu ensayo", "te lo resuelvo", "la solución es",
    "la solucion es", "copia esto", "puedes entregar esto",
]

# The weeks (number, unit, dates, topic) and units of the course.
WEEKS = [
    (1, 1, "16-22 marzo", "Conceptos demográficos y principales indicadores"),
    (2, 1, "23-29 marzo", "Transiciones demográficas y epidemiológicas"),
    (3, 1, "30 marzo-5 abril", "Geografía del Perú: Andes, cuencas, El Niño"),
    (4, 1, "6-12 abril", "Organización del territorio; ciudades y redes urbanas"),
    (5, 1, "13-19 abril", "Esquema urbano-rural y redes urbanas"),
    (6, 1, "20-26 abril", "Cambio climático, desastres y políticas de desarrollo"),
    (7, 1, "27 abril-3 mayo", "El caso de la región Áncash"),
    (8, None, "4-10 mayo", "EXÁMENES PARCIALES (5 de mayo)"),
    (9, 2, "11-17 mayo", "La idea de nación; construcción del Estado nacional"),
    (10, 2, "18-24 mayo", "Regiones y macrorregiones; la costa norte colonial"),
    (11, 2, "25-31 mayo", "Independencia: norte patriota y sur realista"),
    (12, 2, "1-7 junio", "Haciendas azucareras y APRA; sur andino prehispánico"),
    (13, 2, "8-14 junio", "Sur andino colonial; Confederación Perú-Boliviana"),
    (14, 2, "15-21 junio", "Arequipa s.XIX; movimientos indígenas s.XX"),
]
UNITS = [
    (1, "Demografía, territorio y medioambiente en el Perú"),
    (2, "Procesos socioeconómicos y recursos naturales en los espacios regionales"),
]

# Limits.
BUDGET = {"puntual": 3500, "conceptual": 9000, "amplia": 14000}
FRAGMENTS = {"puntual": 4, "conceptual": 10, "amplia": 14}
AUTHORITY = {"oficial": 1.15, "academica": 1.0, "docente": 0.92}
LEXICAL, DENSE, STRUCTURAL = 40, 40, 20
RRF_K, DENSE_CUT, QUOTA, FILL = 60, 0.20, 3, 0.92
COVER_CORE, COVER_OTHER = 0.55, 0.40
SIM_HIGH, SIM_LOW, LEXICAL_GATE, GREY_GATE = 0.51, 0.30, 1.0, 1.4
BRIDGES, POOL, BEAM, ROUNDS = 5, 20, 12, 3
MIN_BLOCK, MIN_SENTENCE, MIN_OCR_LINE, OCR_RATIO = 40, 40, 20, 0.5
"""Budgets count words between white space."""
