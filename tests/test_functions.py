import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom import config
from voxloom.functions import audio as A
from voxloom.functions import chunks as C
from voxloom.functions import numbers as N
from voxloom.functions import stress as Z
from voxloom.functions import text as T
from voxloom.plans.literals import NUMBERS

RATE = 16_000


def tone(seconds, level=0.5, hz=220):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)).astype(np.float32)


@pytest.mark.parametrize("text,words", NUMBERS.items())
def test_numbers(text, words):
    assert N.expand(text) == words


@pytest.mark.parametrize("n,words", [(0, "нуль"), (1_000_000, "одна мільйон"), (21_000, "двадцять одна тисяча"), (-5, "мінус п'ять"), (112, "сто дванадцять"), (2_000_003, "дві мільйони три")])
def test_cardinal(n, words):
    assert N.cardinal(n) == words


@pytest.mark.parametrize("args,words", [((3, "masc", "gen"), "третього"), ((3, "fem"), "третя"), ((2000,), "дві тисячі"), ((1984,), "тисяча дев'ятсот вісімдесят четвертий"), ((500, "neut"), "п'ятисоте")])
def test_ordinal(args, words):
    assert N.ordinal(*args) == words


def test_number_out_of_range_stays():
    assert N.expand("9" * 14) == "9" * 14
    assert N.is_ukrainian(None) and N.is_ukrainian("uk-UA") and not N.is_ukrainian("en")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc, .;\n", max_size=120), st.integers(1, 30))
def test_chunks_keep_all_but_spaces(text, most):
    parts = C.chunks(text, most)
    assert all(0 < len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_stress():
    words = Z.lexicon(["# x", "Ра́льф", "мама\tма́ма", "мама\tмама́", "bad"])
    assert Z.mark_words("мама РАЛЬФ", words) == "мама́ РА́ЛЬФ"
    assert Z.mark_words("ма́ма", words) == "ма́ма"
    assert Z.repair_apostrophes("мама´ і ´так´") == "мама" + Z.MARK + " і 'так" + Z.MARK
    assert Z.prepare("15 мама", "uk", words) == "п'ятнадцять мама́"


def test_clean_text_drops_marks(spark):
    d = spark.createDataFrame([("Привіт | як  справи?",), ("а́...б<>",), (None,)], "t string")
    assert [r[0] for r in d.select(T.clean_field(F.col("t"))).collect()] == ["Привіт як справи?", "а.б", None]


def test_slugify_refuses_empty(spark):
    with pytest.raises(Exception, match="no letter or digit"):
        spark.createDataFrame([("!!",)], "t string").select(T.slugify(F.col("t"))).collect()


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_levels_ignore_pauses():
    x = tone(2)
    with_pause = np.concatenate([x, np.zeros(RATE, np.float32)])
    assert abs(20 * np.log10(A.speech_rms(with_pause, RATE) / A.speech_rms(x, RATE))) < 0.5
    assert A.peak(A.soft_ceiling(x, 10, A.CEILING)) <= A.CEILING
    y = A.match_level(tone(2, 0.05), RATE, 0.15, 0.9)
    assert abs(A.speech_rms(y, RATE) - 0.15) < 0.02


def test_join_and_fade():
    a, b = tone(1), tone(1)
    assert len(A.join([a, b], RATE)) == 2 * RATE - int(RATE * 0.04)
    faded = tone(6) * np.linspace(1, 0.2, 6 * RATE).astype(np.float32)
    fixed = A.undo_fade(faded, RATE)
    assert A.speech_rms(fixed[-RATE:], RATE) > 1.5 * A.speech_rms(faded[-RATE:], RATE)
    assert A.undo_fade(a, RATE) is a


def test_slot_and_stretch():
    pause = np.zeros(int(RATE * 0.2), np.float32)
    x = np.concatenate([tone(1), pause, tone(1)])
    y = A.fit_slot(x, RATE, tone(4), RATE, 9, 9)
    assert abs(len(y) / RATE - 4) < 0.2
    assert abs(len(A.stretch(tone(2), 1.1)) - 2 * RATE / 1.1) < 2
    assert sum(A.share_out(10, [3, 3, 3])) == 10
    assert sum(map(len, [np.sum(A.bands(x, RATE), axis=0)])) == len(x)
    assert np.allclose(np.sum(A.bands(x, RATE), axis=0), x, atol=1e-4)


def test_stress_by_sound():
    loud = np.concatenate([tone(0.2, 0.1), tone(0.2, 0.8)])
    assert A.mark_by_sound("мама", loud, RATE) == "мама" + Z.MARK
    assert A.mark_by_sound("мама", tone(0.4), RATE) == "мама"
    assert A.mark_by_sound("йому", loud, RATE) == "йому"


def test_wav():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(44_100)
        w.writeframes(b"\0\0" * 66_150)
    assert A.wav_header(out.getvalue()) == (1.5, 44_100)
    assert A.wav_header(b"junk") == (None, None)
    assert A.wav_header(A.cut_wav(out.getvalue(), 0.5, 1.0))[0] == pytest.approx(0.6, abs=0.01)


def test_settings():
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Own:
        rate: int = 1
        on: bool = True
        share: float | None = 0.5
        names: list[str] = ()

    got = config.from_env(Own, "x", {"X_RATE": "9000", "X_ON": "False", "X_SHARE": "none", "X_NAMES": "a, b"})
    assert got == Own(9000, False, None, ["a", "b"])
    assert config.steps(["export", "nonsense", "segment"]) == ["segment", "export"]
    with pytest.raises(ValueError, match="b, c"):
        config.pick([{"slug": "a"}], ["c", "a", "b"])
    with pytest.raises(ValueError, match="given twice: a"):
        config.sources('[{"slug": "a"}, {"slug": "a"}]')


@pytest.mark.parametrize("kind,bits", [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_wav_of_every_width(kind, bits):
    import struct

    want = np.array([[0.0, 0.5], [-0.5, -1.0], [0.25, 0.75]])
    if kind == 3:
        raw = want.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = (want * 127 + 128).round().clip(0, 255).astype(np.uint8).tobytes()
    else:
        whole = (want * (2 ** (bits - 1) - 1)).round().astype("<i8")
        raw = b"".join(int(x).to_bytes(8, "little", signed=True)[: bits // 8] for x in whole.ravel())
    for extensible in (False, True):
        head = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, 2, 8000, 8000 * 2 * bits // 8, 2 * bits // 8, bits)
        if extensible:
            head += struct.pack("<HHIH", 22, bits, 3, kind) + bytes(14)
        chunks = b"fmt " + struct.pack("<I", len(head)) + head + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
        x, rate = A.wav_samples(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
        assert rate == 8000 and np.allclose(x, want.mean(axis=1), atol=0.01)


def test_wav_of_other_formats_is_an_error():
    import struct

    for kind, bits in ((1, 12), (6, 8), (3, 16)):
        head = struct.pack("<HHIIHH", kind, 1, 8000, 8000, 1, bits)
        with pytest.raises(ValueError, match="WAV format"):
            A.wav_samples(b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + bytes(4))
    with pytest.raises(ValueError):
        A.wav_samples(b"ID3")


def test_weak_words_and_modules(spark):
    assert len(A.WEAK) == 130 and {"не", "вже", "також", "нехай"} <= A.WEAK
    d = spark.createDataFrame([("text_model.x",), ("audio_decoder.layers.1",), ("audio_decoder.codebook_embeddings.w",), ("else",), (None,)], "k string")
    assert [r[0] for r in d.select(T.module_group(F.col("k"))).collect()] == ["text_model (slow AR)", "audio_decoder.layers (fast AR)", "audio_decoder.codebook", "other", "other"]


def test_sql_functions(spark):
    from voxloom.functions.register import register

    register(spark)
    spark.createDataFrame([(1, "35% алкоголю і Сховище 81"), (2, None), (3, "Памятаєте?")], "id int, text string").createOrReplaceTempView("lines")
    assert spark.sql("SELECT expand_numbers(text), repair_apostrophes(text) FROM lines WHERE id <> 1 ORDER BY id").collect()[1][:] == ("Памятаєте?", "Пам'ятаєте?")
    got = spark.sql("SELECT id, rule, span FROM lines, LATERAL number_spans(text) ORDER BY start").collect()
    assert [tuple(r) for r in got] == [(1, "percent", "35%"), (1, "vault_id", "Сховище 81")]
    assert [tuple(r) for r in spark.sql("SELECT k, chunk FROM lines, LATERAL chunks(text, 12) WHERE id = 1 ORDER BY k").collect()] == list(enumerate(C.chunks("35% алкоголю і Сховище 81", 12)))
    spark.catalog.dropTempView("lines")


def rms(x):
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))


def spoken_lines():
    """Lines of speech with a fault each: (samples, where the fault is, where it is compared with, least and most of the ratio)."""
    at = lambda a, b: slice(int(RATE * a), int(RATE * b))
    faded = tone(2, 0.18, 400)
    faded[-int(RATE * 0.35) :] *= np.linspace(1, 0.15, int(RATE * 0.35), dtype=np.float32)
    yield "faded ending", faded, at(1.88, 1.97), at(1, 1.25), 0.7, 1.5
    yield "whispered last word", np.concatenate([tone(1.4, 0.2, 400), tone(0.06, 0.002, 400), tone(0.35, 0.012, 400)]), at(1.53, 1.77), at(0.4, 1), 0.7, 1.5
    yield "weak last syllable", np.concatenate([tone(1.4, 0.2, 400), tone(0.22, 0.018, 400)]), at(1.44, 1.59), at(0.4, 1), 0.7, 1.5
    yield "dip in a word", np.concatenate([tone(0.8, 0.2, 400), tone(0.05, 0.03, 400), tone(0.4, 0.2, 400)]), at(0.808, 0.842), at(0.72, 0.8), 0.55, 1.5
    yield "hole in a word", np.concatenate([tone(0.8, 0.2, 400), np.zeros(int(RATE * 0.025), np.float32), tone(0.35, 0.2, 400)]), at(0.804, 0.821), at(0.72, 0.8), 0, 0.35
    yield "pause", np.concatenate([tone(0.6, 0.2, 400), np.zeros(int(RATE * 0.4), np.float32), tone(0.6, 0.2, 400)]), at(0.65, 0.95), at(0.1, 0.5), 0, 0.1
    yield "loud ending", tone(1.5, 0.18, 400), at(1.46, 1.49), at(0.5, 0.8), 0.7, 1.5


@pytest.mark.parametrize("line", list(spoken_lines()), ids=lambda x: x[0])
def test_remaster_evens_speech_only(line):
    _, x, fault, beside, least, most = line
    y = A.remaster(x, RATE)
    assert len(y) == len(x) and A.peak(y) <= A.LIMIT + 1e-6 and y[-1] == 0
    assert least <= rms(y[fault]) / rms(y[beside]) <= most


def test_remaster_parts():
    x = tone(1, 0.3, 100) + tone(1, 0.3, 1000) + tone(1, 0.3, 5000)
    assert np.allclose(sum(A.bands(x, RATE)), x, atol=1e-4) and len(A.bands(x, RATE)) == 5
    assert rms(A.highpass(tone(1, 0.5, 30), RATE)) < 0.1 * rms(tone(1, 0.5, 30)) and rms(A.highpass(tone(1, 0.5, 400), RATE)) > 0.99 * rms(tone(1, 0.5, 400))
    hiss = tone(1, 0.05, 3000) + tone(1, 0.4, 7000)
    soft = A.without_hiss(hiss, RATE, 0.001)
    band = lambda y, a, b: rms(A.between(y, RATE, a, b))
    assert band(soft, 6500, 7500) < 0.75 * band(hiss, 6500, 7500) and band(soft, 2500, 3500) > 0.7 * band(hiss, 2500, 3500)
    assert np.allclose(A.without_hiss(x, RATE, 0.001), x, atol=0.02)
    spike = tone(1, 0.5)
    spike[8000] = 3.0
    y = A.limit_ahead(spike, RATE)
    assert A.peak(y) <= A.LIMIT + 1e-6 and rms(y[:4000]) == pytest.approx(rms(spike[:4000]), rel=0.01)
    dull = tone(1.5, 0.18, 450) + tone(1.5, 0.012, 3200)
    ratio = lambda y: band(y, 2500, 4500) / band(y, 250, 800)
    assert ratio(A.remaster(dull, RATE)) > 1.4 * ratio(dull)
    assert (A.remaster(np.zeros(RATE, np.float32), RATE) == 0).all() and A.remaster(np.stack([x, x], axis=1), RATE).shape == (RATE, 2)
