"""Column functions: flags, gates, zones, scores.  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of sample flags, quality reasons and inference reasons.
FLAG_BITS = {"valid": 1, "clipping": 2, "overflow": 4, "dropout": 8, "lead_off": 16, "contact": 32}
QUALITY_BITS = {
    "incomplete": 1, "overflow": 2, "clipping": 4, "no_contact": 8, "low_perfusion": 16, "low_correlation": 32,
    "lead_off": 64, "low_variation": 128, "implausible_peaks": 256,
}

# Candidate thresholds.
PPG_CLIP = (1000, 260000)
ECG_CLIP = (8, 4087)
CONTACT_IR = 50000
MIN_COMPLETENESS = 0.98
MAX_CLIPPING = 0.01
MIN_PERFUSION = 0.001
MIN_CORRELATION = 0.5
MIN_ECG_STD = 4.0
MIN_PEAKS = 3
ADC_FULL = 262143


def bitmask(conditions: dict[int, Column]) -> Column:
    """The sum of the bits whose condition holds; null conditions don't."""
    total = F.lit(0)
    for bit, condition in conditions.items():
        total = total + F.when(condition, F.lit(bit)).otherwise(F.lit(0))
    return total


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ppg_flags(red: Column, ir: Column, overflow: Column, dropout: Column) -> Column:
    """Valid, clipping of either channel (rails included), contact, and the context bits."""
    low, high = PPG_CLIP
    clipped = (red <= low) | (red >= high) | (ir <= low) | (ir >= high)
    return bitmask({1: F.lit(True), 2: clipped, 4: overflow, 8: dropout, 32: ir >= CONTACT_IR})


def ecg_flags(raw: Column, lead_off: Column, dropout: Column) -> Column:
    """Valid, clipping, lead-off and dropout."""
    low, high = ECG_CLIP
    return bitmask({1: F.lit(True), 2: (raw <= low) | (raw >= high), 8: dropout, 16: lead_off})


def completeness(received: Column, expected: Column) -> Column:
    """Received of expected, 1 at most; 0 if none was expected."""
    return F.when(expected > 0, F.least(F.lit(1.0), received / expected)).otherwise(F.lit(0.0))


def rail(raw: Column, low: float, high: float) -> Column:
    """P10: at or beyond the converter's rails."""
    return (raw <= low) | (raw >= high)


def spo2_fault(ir: Column, red: Column, min_ir: int = 10000) -> Column:
    """1 beyond the converter's range, 2 at its end, 3 dark or zero, 0 usable."""
    return (
        F.when((ir > ADC_FULL) | (red > ADC_FULL), 1)
        .when((ir == ADC_FULL) | (red == ADC_FULL), 2)
        .when((ir == 0) | (red == 0) | (ir < min_ir), 3)
        .otherwise(0)
    )


def spo2_zone(percent: Column, valid: Column) -> Column:
    """The rounded percentage's zone, unknown if not valid."""
    whole = F.round(percent)
    return F.when(~valid | percent.isNull(), "unknown").when(whole >= 95, "normal").when(whole >= 93, "attention").otherwise("low")


def bpm_zone(bpm: Column, resting: Column) -> Column:
    """The unrounded rate's zone, unknown unless at rest."""
    return F.when(~resting | bpm.isNull(), "unknown").when(bpm < 60, "low").when(bpm <= 100, "normal").otherwise("high")


def ppg_quality(received, expected, dropped, overflow, queue_drop, clipped, contact, ir_ac, ir_dc, correlation, peaks) -> dict[str, Column]:
    """A10: reasons, score (the mean of four clamped scores) and status of a PPG window."""
    complete = completeness(received, expected)
    clipping = F.when(received > 0, clipped / received).otherwise(F.lit(1.0))
    perfusion = F.when(ir_dc > 0, ir_ac / ir_dc).otherwise(F.lit(0.0))
    reasons = bitmask(
        {
            1: (complete < MIN_COMPLETENESS) | (dropped > 0),
            2: (overflow > 0) | (queue_drop > 0),
            4: clipping > MAX_CLIPPING,
            8: ~contact,
            16: perfusion < MIN_PERFUSION,
            32: F.abs(correlation) < MIN_CORRELATION,
            256: peaks < MIN_PEAKS,
        }
    )
    score = 0.25 * (
        clamp(complete, 0.0, 1.0) + clamp(1.0 - clipping * 20.0, 0.0, 1.0) + clamp(perfusion / (MIN_PERFUSION * 3), 0.0, 1.0) + clamp(F.abs(correlation), 0.0, 1.0)
    )
    return {"reasons": reasons, "score": score, "status": F.when(reasons == 0, "good").otherwise("poor")}


def ecg_quality(received, expected, dropped, queue_drop, clipped, lead_off, std, peaks) -> dict[str, Column]:
    """The same for an ECG window."""
    complete = completeness(received, expected)
    clipping = F.when(received > 0, clipped / received).otherwise(F.lit(1.0))
    reasons = bitmask(
        {
            1: complete < MIN_COMPLETENESS,
            2: (queue_drop > 0) | (dropped > 0),
            4: clipping > MAX_CLIPPING,
            64: lead_off > 0,
            128: std < MIN_ECG_STD,
            256: peaks < MIN_PEAKS,
        }
    )
    score = 0.25 * (
        clamp(complete, 0.0, 1.0) + clamp(1.0 - clipping * 20.0, 0.0, 1.0) + clamp(std / (MIN_ECG_STD * 4), 0.0, 1.0) + F.when(lead_off == 0, 1.0).otherwise(0.0)
    )
    return {"reasons": reasons, "score": score, "status": F.when(reasons == 0, "good").otherwise("poor")}


def ratio_of_ratios(red_ac: Column, red_dc: Column, ir_ac: Column, ir_dc: Column, low: float = 0.2, high: float = 1.8) -> tuple[Column, Column]:
    """The ratio, null where a level is not positive, and the line's
    percentage -25 R + 110 clamped to 0..100, null outside ``low``..``high``."""
    usable = (red_dc > 0) & (ir_dc > 0) & (ir_ac > 0)
    ratio = F.when(usable, (red_ac / red_dc) / (ir_ac / ir_dc))
    return ratio, F.when(ratio.between(low, high), clamp(-25.0 * ratio + 110.0, 0.0, 100.0))


def logistic_score(features: Sequence[Column], mean: Sequence[float], scale: Sequence[float], coef: Sequence[float], intercept: float) -> Column:
    """A standard scaler and logistic regression as one expression; the
    sigmoid is computed on the side where exp can't overflow."""
    z = F.lit(float(intercept))
    for x, m, s, c in zip(features, mean, scale, coef, strict=True):
        z = z + (x - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(c))
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def model_result(features: dict[str, Column], expected: Sequence[str], probability: Column) -> dict[str, Column]:
    """What a model may say: nothing if its inputs have other names or another
    order than ``expected`` (an error when planned) or one isn't finite."""
    if list(features) != list(expected):
        raise ValueError(f"the model takes {', '.join(expected)}")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    finite = F.lit(True)
    for x in features.values():
        finite = finite & ok(x)
    valid = finite & ok(probability)
    return {"model_available": finite, "valid": valid, "probability": F.when(valid, probability), "complement": F.when(valid, 1.0 - probability)}


def stress_branch(quality_good: Column, quality_reasons: Column, vector_status: Column, probability: Column) -> dict[str, Column]:
    """The gates in order, then the score; confidence is that of the label."""
    reached = quality_good & (vector_status == "ready") & finite(probability)
    status = (
        F.when(~quality_good, "quality_rejected")
        .when(vector_status == "not_ready", "not_ready")
        .when(vector_status == "quality_rejected", "quality_rejected")
        .when(vector_status != "ready", "invalid_input")
        .when(~finite(probability), "error")
        .otherwise("valid")
    )
    alert = reached & (probability >= 0.5)
    return {
        "status": status,
        "reason_flags": F.when(~quality_good, quality_reasons).otherwise(F.lit(0)),
        "score": F.when(reached, probability),
        "confidence": F.when(reached, F.when(alert, probability).otherwise(1.0 - probability)),
        "alert": alert,
        "label": F.when(reached, F.when(alert, "stress").otherwise("baseline")),
    }


def rhythm_branch(quality_good: Column, quality_reasons: Column, vector_status: Column, model_available: Column, probability: Column) -> dict[str, Column]:
    """The gates in order, then the more probable label.  Reasons beside those of
    quality: 1 too few intervals, 2 interval quality, 4 no model, 8 model error; a
    negative result is never conclusive."""
    usable = finite(probability)
    gates = [
        (~quality_good, "quality_rejected", quality_reasons),
        (vector_status == "not_ready", "not_ready", F.lit(1)),
        (vector_status == "quality_rejected", "quality_rejected", F.lit(2)),
        (vector_status != "ready", "invalid_input", F.lit(0)),
        (~model_available, "not_ready", F.lit(4)),
        (~usable, "error", F.lit(8)),
    ]
    status, reasons = F.lit("valid"), F.lit(0)
    for closed, name, reason in reversed(gates):
        status, reasons = F.when(closed, name).otherwise(status), F.when(closed, reason).otherwise(reasons)
    reached = status == "valid"
    alert = reached & (probability > 1.0 - probability)
    return {
        "status": status,
        "reason_flags": reasons,
        "score": F.when(reached, probability),
        "confidence": F.when(reached, F.greatest(probability, 1.0 - probability)),
        "alert": alert,
        "label": F.when(reached, F.when(alert, "AF").otherwise("nonAF")),
        "negative_conclusive": F.lit(False),
    }


def pulse_arrival(ecg_us: Column, ppg_us: Column) -> Column:
    """Milliseconds from the last R peak to the last pulse, if 50 to 600 and both are there."""
    delay = (ppg_us - ecg_us) / 1000.0
    return F.when((ecg_us > 0) & (ppg_us > ecg_us) & delay.between(50.0, 600.0), delay)


def oxygen_value_status(estimator: Column, input_rejected: Column) -> Column:
    """What an estimator's status means for the value."""
    return (
        F.when(input_rejected, "Error")
        .when(estimator == "ok", "Valid")
        .when(estimator == "not_ready", "NotAvailable")
        .when(estimator == "out_of_range", "Error")
        .otherwise("InvalidSignal")
    )


def decision(statuses: Sequence[Column], alerts: Sequence[Column], conclusive: Sequence[Column], poor: Column) -> dict[str, Column]:
    """Normal if all branches are valid, without alert and conclusive;
    remeasure on poor quality or a branch that got no usable input."""
    normal, again = F.lit(True), poor
    for s, a, c in zip(statuses, alerts, conclusive, strict=True):
        normal = normal & (s == "valid") & ~a & c
        again = again | s.isin("invalid_input", "quality_rejected")
    return {"normal": normal, "remeasure": again}


def quantize(x: Column, scale: float, zero_point: int, low: int = -128, high: int = 127) -> Column:
    """Saturating quantisation, rounding half away from zero."""
    return F.greatest(F.lit(low), F.least(F.lit(high), (F.round(x / scale) + zero_point))).cast("int")


def dequantize(q: Column, scale: float = 1 / 256, zero_point: int = -128) -> Column:
    """V07."""
    return (q - zero_point) * scale


def smoothed_votes(label: Column, window) -> Column:
    """How many rows of a frame have the row's own label."""
    return F.size(F.filter(F.collect_list(label).over(window), lambda x: x == label))
