"""Constants that determine results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Windowing:
    """Word windows of ``size`` words every ``step``; shorter ones than ``least`` are dropped."""

    size: int
    step: int
    least: int


@dataclass(frozen=True)
class Scoring:
    """Weights of coverage and dice, threshold and phrase bonuses, all in percent."""

    coverage: int
    dice: int
    threshold: int
    bonus: tuple[int, int, int]


# Window sizes, weights, thresholds and limits.
BANK = Windowing(85, 45, 35)
INTERNAL_QUERY = Windowing(85, 45, 30)
WEB_QUERY = Windowing(75, 45, 28)
INTERNAL = Scoring(70, 30, 16, (18, 12, 8))
WEB = Scoring(78, 22, 18, (20, 14, 9))
PHRASE_SIZES, PHRASE_STEP, PHRASE_LEAST_WORDS = (18, 14, 10), 5, 12
SHINGLE_WORDS, MATCHES, STYLE_FINDINGS, BANK_NEWEST, EXCERPT = 4, 35, 20, 5000, 900
LEAST_PAGE, LEAST_TEXT, MOST_PAGES = 500, 100, 16
RISK = ((50, 80, "CRITICAL"), (30, 60, "HIGH"), (15, 35, "MEDIUM"))

# Word lists.
STOP_WORDS = ("referencias", "bibliografía", "bibliografia", "anexos", "anexo")
HEADINGS = (
    "dedicatoria", "agradecimiento", "agradecimientos", "índice", "indice", "tabla de contenido", "resumen", "abstract",
)
COVER_MARKERS = (
    "universidad", "facultad", "escuela", "instituto", "tesis", "trabajo de investigación", "autor", "asesor", "docente",
    "curso",
)
CONNECTORS = (
    "además", "asimismo", "por lo tanto", "por consiguiente", "en consecuencia", "sin embargo", "no obstante",
    "cabe destacar", "es importante mencionar", "en este sentido", "de esta manera", "por otro lado", "en conclusión",
    "finalmente", "en primer lugar", "en segundo lugar", "desde esta perspectiva", "por ende",
)
GENERIC_PHRASES = (
    "el presente trabajo", "la presente investigación", "es importante señalar", "cabe resaltar", "en la actualidad",
    "en el ámbito educativo", "se puede evidenciar", "resulta fundamental", "de manera significativa",
    "contribuye al desarrollo", "permite fortalecer",
)
PERSONAL_MARKERS = (
    "yo", "nosotros", "considero", "observé", "realicé", "apliqué", "mi experiencia", "nuestra experiencia", "entrevisté",
    "visité",
)
LOW_VALUE_MARKERS = (
    "índice", "indice", "dedicatoria", "agradecimiento", "bibliografía", "bibliografia", "referencias", "anexo",
    "tabla de contenido",
)
ACADEMIC_DOMAINS = (
    "repositorio.ucv.edu.pe", "repositorio.upn.edu.pe", "repositorio.usil.edu.pe", "repositorio.unasam.edu.pe",
    "repositorio.une.edu.pe", "repositorio.minedu.gob.pe", "repositorio.concytec.gob.pe", "alicia.concytec.gob.pe",
    "scielo.org", "redalyc.org", "dialnet.unirioja.es",
)
BLOCKED_SUFFIXES = (
    "jpg", "jpeg", "png", "gif", "webp", "zip", "rar", "7z", "mp4", "mp3", "avi", "xls", "xlsx", "ppt", "pptx",
)
