"""Welding calculators and the calculation-question reader, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions import parsing

# Thermal efficiency by process.
EFFICIENCY = {"SAW": 1.0, "SMAW": 0.8, "GMAW": 0.8, "FCAW": 0.8, "MCAW": 0.8, "GTAW": 0.6, "PAW": 0.6}

# Weight-% limits within which CET was validated.
CET_LIMITS = {
    "C": (0.05, 0.32), "Si": (0.0, 0.8), "Mn": (0.5, 1.9), "Cr": (0.0, 1.5),
    "Cu": (0.0, 0.7), "Mo": (0.0, 0.75), "Ni": (0.0, 2.5), "V": (0.0, 0.18), "B": (0.0, 0.005),
}

# Limits within which the preheat estimate was validated.
PREHEAT_LIMITS = {"cet": (0.2, 0.5), "thickness": (10, 90), "hydrogen": (1, 20), "heat_input": (0.5, 4.0)}

# Accepted input ranges (low, high, low end open).
INPUT_LIMITS = {
    "voltage": (0, 100, True), "current": (0, 2500, True), "travel_speed": (0, 20000, True),
    "C": (0, 5, False), "Mn": (0, 30, False), "Si": (0, 10, False), "Cr": (0, 30, False), "Mo": (0, 10, False),
    "V": (0, 10, False), "Ni": (0, 30, False), "Cu": (0, 10, False), "B": (0, 1, False),
    "cet": (0, 2, True), "thickness": (0, 500, True), "hydrogen": (0, 100, True), "heat_input": (0, 20, True),
}


def _code_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def in_limits(name: str, value: Column) -> Column:
    """Whether a calculator input is acceptable at all."""
    low, high, open_low = INPUT_LIMITS[name]
    above = value > low if open_low else value >= low
    return F.coalesce(above & (value <= high), F.lit(False))


def efficiency(process: Column) -> Column:
    return F.try_element_at(_code_map(EFFICIENCY), F.upper(process))


def heat_input(voltage: Column, current: Column, speed: Column, process: Column) -> Column:
    """Struct (arc_energy, heat_input, efficiency, warnings, error)."""
    k = efficiency(process)
    error = F.when(k.isNull(), "unknown process").when(
        (voltage <= 0) | (current <= 0) | (speed <= 0), "inputs must be positive"
    )
    arc = F.when(error.isNull(), voltage * current * 60 / (F.lit(1000) * speed))
    warnings = F.array_compact(
        F.array(
            F.when(~voltage.between(5, 60), F.lit("voltage outside 5-60 V")),
            F.when(speed > 3000, F.lit("travel speed above 3000 mm/min")),
        )
    )
    return F.struct(
        F.round(arc, 3).alias("arc_energy"),
        F.round(arc * k, 3).alias("heat_input"),
        k.alias("efficiency"),
        warnings.alias("warnings"),
        error.alias("error"),
    )


def carbon_equivalent(c: dict[str, Column]) -> Column:
    """Struct (ce_iiw, cet, pcm, warnings, error) from weight-% columns keyed by element."""
    e = {name: c.get(name, F.lit(0.0)) for name in CET_LIMITS}
    bad = F.lit(False)
    for value in e.values():
        bad = bad | (value < 0) | (value > 30)
    error = F.when(bad, "implausible weight percentage")
    iiw = e["C"] + e["Mn"] / 6 + (e["Cr"] + e["Mo"] + e["V"]) / 5 + (e["Ni"] + e["Cu"]) / 15
    cet = e["C"] + (e["Mn"] + e["Mo"]) / 10 + (e["Cr"] + e["Cu"]) / 20 + e["Ni"] / 40
    pcm = (
        e["C"] + e["Si"] / 30 + (e["Mn"] + e["Cu"] + e["Cr"]) / 20
        + e["Ni"] / 60 + e["Mo"] / 15 + e["V"] / 10 + 5 * e["B"]
    )
    flags = [F.when(~e[n].between(lo, hi), F.lit(f"{n} outside {lo}-{hi}")) for n, (lo, hi) in CET_LIMITS.items()]
    flags.append(F.when(e["C"] < 0.18, F.lit("low carbon: prefer Pcm")))
    return F.struct(
        *[F.when(error.isNull(), F.round(v, 3)).alias(n) for n, v in (("ce_iiw", iiw), ("cet", cet), ("pcm", pcm))],
        F.array_compact(F.array(*flags)).alias("warnings"),
        error.alias("error"),
    )


def preheat(cet: Column, thickness: Column, hydrogen: Column, heat: Column) -> Column:
    """Struct (preheat_c, required, warnings, error): minimum preheat by the CET method."""
    error = F.when((cet <= 0) | (thickness <= 0) | (hydrogen <= 0) | (heat <= 0), "inputs must be positive")
    t = (
        697 * cet + 160 * F.tanh(thickness / 35) + 62 * F.pow(hydrogen, F.lit(0.35))
        + (53 * cet - 32) * heat - 328
    )
    inputs = {"cet": cet, "thickness": thickness, "hydrogen": hydrogen, "heat_input": heat}
    flags = [
        F.when(~inputs[n].between(lo, hi), F.lit(f"{n} outside {lo}-{hi}")) for n, (lo, hi) in PREHEAT_LIMITS.items()
    ]
    return F.struct(
        F.when(error.isNull(), F.bround(t, 0).cast("bigint")).alias("preheat_c"),
        F.when(error.isNull(), t > 0).alias("required"),
        F.array_compact(F.array(*flags)).alias("warnings"),
        error.alias("error"),
    )


# -- calculation questions -----------------------------------------------------

_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"

# Wording of calculation questions and of their inputs.
ASKS = r"(?i)\b(calculate|compute|work out|what(?:'s| is| would be)|how much|find)\b"
HEAT_INPUT_TOPIC = r"(?i)\b(heat[\s-]*input|arc[\s-]*energy)\b"
OTHER_TOPIC = r"(?i)\b(carbon equivalent|\bCE\b|\bCET\b|\bPcm\b|preheat)\b"
COMPOSITION = r"[0-9]\s*%|\b(?:C|Mn|Cr|Mo|Ni|Cu|Si|V)\s*[=:]?\s*0?\.[0-9]"
VOLTAGE = rf"(?i){_NUMBER}\s*(?:V|volts?)\b"
CURRENT = rf"{_NUMBER}\s*(?:A|amps?|amperes?)\b"
SPEEDS = (
    (rf"(?i){_NUMBER}\s*mm\s*/\s*min", 1.0),
    (rf"(?i){_NUMBER}\s*mm\s*/\s*s(?:ec)?\b", 60.0),
    (rf"(?i){_NUMBER}\s*cm\s*/\s*min", 10.0),
    (rf"(?i){_NUMBER}\s*(?:in|ipm|inch(?:es)?)\s*/?\s*(?:min)?\b", 25.4),
)


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def travel_speed(text: Column) -> Column:
    """Travel speed in mm/min from any of four units."""
    return F.coalesce(*[_number(text, pattern) * factor for pattern, factor in SPEEDS])


def calculation(question: Column) -> Column:
    """Struct (kind, voltage, current, speed, process, missing), null for ordinary questions.

    kind is ``heat_input``, ``missing_inputs`` or ``composition``.
    """
    volts, amps, speed = _number(question, VOLTAGE), _number(question, CURRENT), travel_speed(question)
    process = F.try_element_at(parsing.processes(question), F.lit(1))
    topic = question.rlike(HEAT_INPUT_TOPIC)
    # a zero speed reads as no speed at all, as any falsy number does in the question reader
    speed = F.when(speed != 0, speed)
    some = volts.isNotNull() | amps.isNotNull() | speed.isNotNull()
    missing = F.array_compact(
        F.array(
            F.when(volts.isNull(), F.lit("arc voltage")),
            F.when(amps.isNull(), F.lit("welding current")),
            F.when(speed.isNull(), F.lit("travel speed")),
            F.when(process.isNull(), F.lit("process")),
        )
    )
    kind = F.when(
        question.rlike(ASKS),
        F.when(topic, F.when(some, F.when(F.size(missing) == 0, "heat_input").otherwise("missing_inputs"))).when(
            question.rlike(OTHER_TOPIC) & question.rlike(COMPOSITION), "composition"
        ),
    )
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("kind"), volts.alias("voltage"), amps.alias("current"), speed.alias("speed"),
            process.alias("process"), missing.alias("missing"),
        ),
    )
