"""Parameters and vocabularies, as data: every operator takes them as arguments, and these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# The defaults of the three classes below.


@dataclass(frozen=True)
class WindowConfig:
    length: float = 20.0
    stride: float = 5.0
    margin: float = 10.0


@dataclass(frozen=True)
class LabelConfig:
    goal_span: tuple[float, float] = (-3.0, 12.0)
    big_chance_span: tuple[float, float] = (-3.0, 8.0)
    big_chance_min_xg: float = 0.3
    card_search: tuple[float, float] = (0.0, 120.0)
    penalty_span: tuple[float, float] = (-3.0, 30.0)
    min_overlap: float = 3.0
    ignore_near: float = 10.0
    block_overlap: float = 5.0


@dataclass(frozen=True)
class TriggerConfig:
    gap: float = 30.0
    max_len: float = 120.0
    # an event e is caught by a trigger if start - hi <= e <= end - lo
    tolerance: dict = field(default_factory=lambda: {"goal": (-30.0, 30.0), "card": (-10.0, 120.0), "big_chance": (-30.0, 30.0), "controversy": (-30.0, 30.0)})


@dataclass(frozen=True)
class Config:
    windows: WindowConfig = WindowConfig()
    labels: LabelConfig = LabelConfig()
    events: TriggerConfig = TriggerConfig()


#: Names in a parameter file that aren't those of the classes.
_NAMES = {"length_s": "length", "stride_s": "stride", "margin_s": "margin", "min_overlap_s": "min_overlap", "ignore_near_s": "ignore_near", "merge_gap_s": "gap", "max_trigger_s": "max_len"}
#: Parameters that nothing here depends on.
_UNUSED = {"card_fallback_span"}


def read_config(text: str) -> Config:
    """Parameters of a YAML text with the sections windows, labels and events; what isn't there keeps its default, and a name or section
    that nobody knows is an error. match_tolerance_s is the tolerance, to both sides, of every question but card, whose own stays."""
    import yaml

    told = yaml.safe_load(text) or {}
    if unknown := set(told) - {"windows", "labels", "events"}:
        raise ValueError(f"no section {sorted(unknown)}")
    out = {}
    for section, kind in (("windows", WindowConfig), ("labels", LabelConfig), ("events", TriggerConfig)):
        given = {_NAMES.get(k, k): tuple(map(float, v)) if isinstance(v, list) else v for k, v in (told.get(section) or {}).items() if k not in _UNUSED}
        if section == "events" and "match_tolerance_s" in given:
            wide = float(given.pop("match_tolerance_s"))
            given.setdefault("tolerance", {q: (-wide, wide) if q != "card" else t for q, t in TriggerConfig().tolerance.items()})
        if unknown := set(given) - {f.name for f in fields(kind)}:
            raise ValueError(f"{section} has no {sorted(unknown)}")
        out[section] = kind(**{k: float(v) if isinstance(v, int) else v for k, v in given.items()})
    return Config(**out)


QUESTIONS = ("goal", "big_chance", "controversy", "card")
LEVELS = ("calm", "building", "peak")

# The rule vocabulary of Portuguese narration; a hit is one non-overlapping match.
RULES = {
    "goal": r"\bgo+l+\b|golaço|golasso",
    "big_chance": "na trave|no travessão|que chance|quase|perdeu|defendeu|defesa|defesaça|milagre|por cima|pra fora|para fora|raspando|tirou em cima|salvou",
    "controversy": r"\bvar\b|revis[ãa]o|pênalti|penalti|impedimento|impedido|anulad|polêmic|reclama|o árbitro|o juiz|arbitragem",
    "card": "cartão|amarelo|vermelho|expuls",
}

# Name, anchor, pattern, lag, cap and weight of the cues that tie narration to events.
CUES = (
    ("goal_call", "goal", r"go{2,}l|gol\b|golaço", 2.0, 30.0, 5.0),
    ("goal_score", "goal", r"faz (o )?\d ?(x|a) ?\d|abre o placar|amplia|empata o jogo|empatou|virou o jogo", 20.0, 30.0, 5.0),
    ("corner", "corner", "escanteio", -12.0, 40.0, 1.0),
    ("shot", "shot", "chut|bateu|bate (de|pro|para|cruzado|colocado|forte)|finaliz|cabece|testou|de cabeça|pra fora|para fora|defende|defendeu|na trave|por cima", 1.0, 12.0, 1.0),
    ("period_start", "period_start", "rola a bola|rolar a bola|rolou a bola|bola rolando|bola est[áa] rolando|simbora|come[çc]a (o|a|a partida|o jogo)|come[çc]ou|apitou|t[áa] valendo|est[áa] valendo|autoriza o árbitro", 0.0, 60.0, 3.0),
    ("period_end", "period_end", "termina (o|a|o jogo|o primeiro|o segundo)|fim de (jogo|papo|primeiro|segundo)|final de (jogo|primeiro|segundo)|acabou|encerrad|apita o (fim|final)|vamos para o intervalo", 5.0, 60.0, 2.0),
)

# Stock phrases that speech recognition invents over silence.
STOCK_PHRASES = r"amara\.org|legendas? (pela|por)|obrigad[oa] por assistir|inscreva-se|ative o sininho|legendado por|tradução e legendas|www\.|\.com\b"

# Seconds from the end of a period to the start of the one named, and search radii.
BREAK_BEFORE = {2: 900.0, 3: 300.0, 4: 60.0, 5: 300.0}
RADIUS_FIRST, RADIUS_LATER = 1200.0, 600.0
SHOOTOUT = 5
