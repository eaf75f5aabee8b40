"""Word lists of the text features. Results depend on these very words."""

from __future__ import annotations

ABSOLUTIST = (
    "siempre", "nunca", "jamás", "todo", "todos", "toda", "todas", "nada", "nadie", "ninguno", "ninguna", "ningún", "completamente", "totalmente",
    "absolutamente", "constantemente", "definitivamente", "entero", "entera",
)
NEGATION = ("no", "nunca", "jamás", "nada", "nadie", "ninguno", "ningún", "tampoco", "ni")
MARKERS = ("bueno", "pues", "entonces", "digamos", "claro", "obviamente", "realmente")
MARKER_PHRASES = ("o sea", "osea", "es que", "como que", "la verdad", "de pronto", "por ejemplo", "en realidad", "digamos que", "nada mas", "asi que")
INTENSIFIERS = ("muy", "bastante", "demasiado", "súper", "super", "tan", "tanto", "totalmente", "completamente", "bien", "harto", "full")
MODALS = ("poder", "deber", "querer", "necesitar", "intentar", "tratar")
MODAL_PHRASES = ("tener que", "hay que", "toca que")

# Symptom groups and their terms.
SUBSCALES = {
    "anhedonia": ("interés", "placer", "desmotivado", "motivación"),
    "animo": ("decaído", "deprimido", "depresión", "esperanza", "desesperanza", "triste", "tristeza", "llorar", "bajón", "desánimo", "vacío"),
    "sueno": ("dormir", "sueño", "insomnio"),
    "energia": ("cansado", "cansancio", "energía", "agotado", "agotamiento"),
    "apetito": ("apetito", "comer"),
    "culpa": ("fracaso", "culpa", "culpable", "autoestima"),
    "concentracion": ("concentrar", "concentración"),
    "psicomotor": ("lento", "inquieto", "inquietud"),
    "autolesion": ("muerte", "morir", "lastimar", "suicidio", "autolesión"),
    "nervios": ("nervioso", "nervio", "ansioso", "ansiedad", "angustia", "angustiado", "relajar"),
    "preocupacion": ("preocupar", "preocupación", "preocupado", "sobrepensar"),
    "irritabilidad": ("irritable", "irritabilidad", "irritar"),
    "miedo": ("miedo", "temor", "pánico", "terrible"),
    "estres": ("estrés", "estresado", "estresar", "agobiado", "agobio", "abrumado", "frustrado", "frustración"),
    "soledad": ("solo", "soledad"),
}
# Inflected forms that count for a group as well.
INFLECTIONS = {
    "anhedonia": ("intereses", "desmotivada", "desmotivados", "desmotivadas"),
    "animo": ("decaída", "decaídos", "decaídas", "deprimida", "deprimidos", "deprimidas", "depresiones", "tristes", "lloro", "lloras", "llora", "lloraba", "bajones", "vacía", "vacíos", "vacías"),
    "sueno": ("duermo", "duermes", "duerme", "duermen", "durmiendo", "dormía", "dormido", "sueños"),
    "energia": ("cansada", "cansados", "cansadas", "agotada", "agotados", "agotadas", "energías"),
    "apetito": ("como", "comes", "come", "comen", "comiendo", "comía"),
    "culpa": ("culpables", "fracasos", "culpas"),
    "concentracion": ("concentro", "concentras", "concentra", "concentrarme", "concentraciones"),
    "psicomotor": ("lenta", "lentos", "lentas", "inquieta", "inquietos", "inquietas"),
    "autolesion": ("muero", "mueres", "muere", "mueren", "muriendo", "muertes"),
    "nervios": ("nerviosa", "nerviosos", "nerviosas", "ansiosa", "ansiosos", "ansiosas", "angustiada", "angustiados", "angustiadas", "nervios", "relajo", "relaja", "relajarme"),
    "preocupacion": ("preocupada", "preocupados", "preocupadas", "preocupo", "preocupa", "preocupan", "preocuparme", "sobrepienso"),
    "irritabilidad": ("irritables", "irrito", "irrita"),
    "miedo": ("miedos", "terribles"),
    "estres": ("estresada", "estresados", "estresadas", "agobiada", "agobiados", "agobiadas", "abrumada", "abrumados", "abrumadas", "frustrada", "frustrados", "frustradas", "estreso", "estresa", "estresarme"),
    "soledad": ("sola", "solos", "solas"),
}
# Forms that count only under these parts of speech.
PARTS_OF_SPEECH = {
    "solo": ("ADJ",), "sola": ("ADJ",), "solos": ("ADJ",), "solas": ("ADJ",), "lento": ("ADJ",), "lenta": ("ADJ",), "lentos": ("ADJ",), "lentas": ("ADJ",),
    "como": ("VERB", "AUX"), "come": ("VERB", "AUX"), "comes": ("VERB", "AUX"), "comen": ("VERB", "AUX"),
}

# Affect scales (valence and arousal 1 to 9, emotions 1 to 5), neutrals and strict cuts.
EMOTIONS = ("happiness", "disgust", "anger", "fear", "sadness")
VALENCE_NEUTRAL, AROUSAL_NEUTRAL, EMOTION_NEUTRAL = 5.0, 5.0, 1.0
VALENCE_LOW, VALENCE_HIGH, AROUSAL_HIGH = 4.0, 6.0, 6.0
AFFECT_POS = ("NOUN", "VERB", "ADJ", "ADV")
DENSITY_POS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
NORM_POS = {"NOUN": "NOUN", "ADJECTIVE": "ADJ", "VERB": "VERB", "ADVERB": "ADV"}
