"""Per-document text statistics, and a Gaussian mixture that tells prose from lists, tables and junk."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polka.session import cut

# Words that running sentences are held together by.
COMMON = set("""
и на не что но а по за к у из о мы я он она они его её ее их это этот эта так же бы был была было были все весь вся как
чтобы когда поэтому уже ещё еще только если потом после перед до от при без или ни то там здесь раньше теперь мне нам
нас меня мой вы вам вас под над про через между чем хотя пока где куда потому который которая которое которые которого
которой которых сам само сами очень почти лучше нет да ли будет есть можно нужно надо тоже также него ней ним
каждый одном одна один две два двух сегодня вчера зато себя со в с
the a an of to and is was were that it i we you not but in on for with at from has have had be been so if then there this
my our your their its which who when while because after before than more most all any no by are as or will would could
should do does did up out just only also he she they them his her one two
""".split())
# Words of COMMON that product names have too.
WEAK = {"в", "с", "со", "на", "за", "по", "от", "до", "из", "для", "и", "нет", "да", "а", "без", "of", "and", "with", "in", "to", "for"}
NAMES = ["words", "mean_word", "symbol_ratio", "digit_ratio", "end_ratio", "common_ratio", "line_words", "odd_ratio", "sentence_ratio"]
KINDS = ("prose", "list", "table", "junk")

_WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
_BULLET = re.compile(r"^\s*(?:[-–—•*·▪+]|\d{1,3}[.)]|\[[ xXхХ]?\]|\(\d+\))\s*")
_QUOTED = re.compile(r"[«\"“][^»\"”]{0,120}[»\"”]")
_TICK = re.compile(r"(?:\s*:\s*(?:да|нет|yes|no)|\s*\(\d+\))\s*[.;,]?\s*$", re.I)
_ODD = re.compile("[─-■\u0080-\u009f­�À-ÿЂ-Џђ-џҐґ]")
_SEPARATOR = re.compile(r"\d+(?:[.,]\d+)*|[;|\t,]")
_HARSH = re.compile("[бвгджзйклмнпрстфхцчшщъьbcdfghjklmnpqrstvwxz]{5}", re.I)
_LOOKS = str.maketrans("aeopcyxkmtbhAEOPCYXKMTBH", "аеорсухкмтвнАЕОРСУХКМТВН")


@lru_cache(100_000)
def _word(w: str) -> tuple[int, bool, bool, bool, bool]:
    """(letters, common, strong, mixed, harsh) of a word, look-alike letters of mixed words brought into one script."""
    cyr, lat = re.search("[а-яё]", w, re.I), re.search("[a-z]", w, re.I)
    low = (w.translate(_LOOKS) if cyr and lat else w).lower()
    plain = low if low in COMMON else low.translate(_LOOKS).lower()
    common = plain in COMMON
    mixed = bool(re.search("[а-яё]", low) and re.search("[a-z]", low))
    return len(w), common, common and low not in WEAK, mixed, bool(_HARSH.search(low))


def _words(text: str) -> list[tuple]:
    return [_word(w) for w in _WORD.findall(text)]


def line_is_sentence(line: str) -> float:
    """How much a line reads like running text: 0 to 1."""
    body = _QUOTED.sub("", _BULLET.sub("", line)).strip()  # names of goods stand in quotes
    body = _TICK.sub("", body)
    words = _words(body)
    if not words:
        return 0.0
    letters = sum(w[0] for w in words)
    solid = len("".join(body.split()))
    if letters < 0.6 * solid or len(_ODD.findall(body)) > 0.1 * letters:
        return 0.0
    if max(w[0] for w in words) > 35 or letters / len(words) > 14:
        return 0.0
    odd = sum(w[3] + w[4] for w in words)
    if odd > 0.15 * len(words) and odd > 1:
        return 0.0
    strong = sum(w[2] for w in words)
    weak = sum(w[1] for w in words) - strong
    if not strong and len(words) <= 5:
        return 0.0
    separators = len(_SEPARATOR.findall(body))
    score = (strong + 0.4 * weak) / len(words) - 0.25 * min(1.0, separators / len(words))
    return max(0.0, min(1.0, score * 6))


def statistics(text: str) -> dict[str, float]:
    """Statistics of one text; all 0 for an empty one. ``sentence_ratio`` is the share of its
    characters that stands in lines or runs of lines that read like sentences."""
    t = text or ""
    lines = [x for x in re.split(r"\r\n|\r|\n", t) if x.strip()]
    words = _words(t)
    solid = "".join(t.split())
    n = max(1, len(solid))
    out = dict.fromkeys(NAMES, 0.0)
    if not solid:
        return out
    letters = sum(w[0] for w in words)
    score = [line_is_sentence(x) for x in lines]
    size = [len("".join(x.split())) for x in lines]
    bullets = [bool(_BULLET.match(x)) for x in lines]
    got = 0.0
    for i in range(len(lines)):
        s = score[i]
        # a wrapped line is judged with its neighbours; list items, single lines and rows of separated values are not
        if not bullets[i] and len(lines) > 1 and (s > 0.0 or len(_SEPARATOR.findall(lines[i])) * 20 < size[i]):
            near = [score[j] for j in (i - 1, i + 1) if 0 <= j < len(lines) and not bullets[j] and size[j] > 17 and size[i] > 8]
            if near:
                s = max(s, 0.5 * s + 0.5 * sum(near) / len(near))
        got += size[i] * (1.0 if s >= 0.3 else s / 0.3)
    out["words"] = math.log1p(len(words))
    out["mean_word"] = min(30.0, letters / max(1, len(words)))
    out["symbol_ratio"] = sum(not ch.isalnum() for ch in solid) / n
    out["digit_ratio"] = sum(ch.isdigit() for ch in solid) / n
    out["end_ratio"] = sum(bool(re.search(r"[.!?…][\s\"»)]*\W{0,4}$", x)) for x in lines) / len(lines)
    out["common_ratio"] = sum(w[1] for w in words) / max(1, len(words))
    out["line_words"] = math.log1p(len(words) / len(lines))
    out["odd_ratio"] = len(_ODD.findall(t)) / n
    out["sentence_ratio"] = got / sum(size)
    return out


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, blank`` and the statistics of ``NAMES``; blanks have zeros."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame([statistics(t) for t in s], columns=NAMES)

    once = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in NAMES))
    blank = F.coalesce(F.regexp_replace("text", r"(?U)[\s\x{200b}\x{feff}]", "") == "", F.lit(True))
    return once.select("doc_id", blank.alias("blank"), udf("text").alias("s")).select("doc_id", "blank", "s.*")


# Inspected examples: texts of each kind that name the components of the mixture.
EXAMPLES = [
    ("prose", "Сегодня с утра я прошёл весь ряд и не нашёл ни одного ценника. Обратите внимание на срок годности, он уже почти вышел."),
    ("prose", "мы договорились, что до конца недели ценники обновят во всех отделах\nесли бирки нет на месте, значит полку ещё не проверили"),
    ("prose", "The manager told me that the loyalty card stopped working, so I will come back later. It was hard to read the tag."),
    ("list", "- Кефир Ключеверх 900 мл\n- Творог Теплохват 0,3 кг\n- Сок Яроварка 1 л\n- Рис Кофельда 1,5 кг"),
    ("list", "Пельмени 700 г, Вода питьевая 3 л, Салфетки бумажные 50 шт, Печенье сдобное 250 г, Кефир 1 л, Чай 100 г"),
    ("list", "[x] Зефир Lindqvarn\n[x] Творог 180 g\n[ ] Йогурт питьевой 750Г\n[ ] Сыр плавленый"),
    ("table", "Код | Товар | Цена | Ед. | Остаток\n65206645 | Лимонад 1.5 Л | 356,90 | л | 47\n47453592 | Творог 0,3 кг | 1034,00 | упак | 148"),
    ("table", "83040962;Хлопья овсяные 800Г;1082,00;л;32\n96468357;Сахар 0,9кг;85,50;упак;210"),
    ("table", "2025-09-14 05:14:31 WARN ocr retry=1 code=timeout\n2025-05-03 11:33:02 WARN ocr retry=4 code=open"),
    ("junk", "=====$$$!!!%%%$$$$$$???=====*** ***!!!-----***???******  -----=====!!!"),
    ("junk", "DTfpZEeoswydzq7Rw5K7bmvax5rUBrh9UhfMjkAEu+2daTfToeTfXohqsITYq6mA2VxY7nGsW9ULpEvTCkdh59nw1w=="),
    ("junk", "ок"),
    ("junk", "Ïîêà øëà èíâåíòàðèçàöèÿ, ÷àñòü òîâàðà ïðîñòî íàêðûëè ïë¸íêîé."),
]


def _log_densities(x, model):
    """Log of weight times density of each component (columns) at each row of ``x``."""
    import numpy as np

    weights, means, covariances = model
    out = np.empty((len(x), len(weights)))
    for j in range(len(weights)):
        root = np.linalg.cholesky(covariances[j])
        z = np.linalg.solve(root, (x - means[j]).T)
        out[:, j] = np.log(weights[j]) - 0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
    return out


def _posteriors(x, model):
    """(posteriors, log likelihoods) of the rows of ``x``."""
    import numpy as np

    logs = _log_densities(x, model)
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - total[:, None]), total


def _moments(x, model):
    """Sufficient statistics of an expectation step: rows, log likelihood, and per component the posterior-weighted sums of 1, x and x x'."""
    import numpy as np

    p, total = _posteriors(x, model)
    second = np.einsum("ij,ia,ib->jab", p, x, x, optimize=True)
    return np.concatenate([[len(x), total.sum()], p.sum(0), (p.T @ x).ravel(), second.ravel()])


def fit_mixture(stats: DataFrame, columns: list[str], starts, ridge: float = 0.01, tolerance: float = 1e-3, rounds: int = 500):
    """``(model, mean, deviation)`` of a Gaussian mixture of full covariances by expectation-maximization.

    All rows of ``stats`` and the rows of ``starts`` (an array of inspected examples, at each of which one component begins) are
    standardized and used in every round. A round is one job: tasks sum the moments of their rows, the sums are added by
    position, and only one number for each moment comes to the driver. It ends when the mean log likelihood moves by no more
    than ``tolerance``; ``rounds`` without that raise ``RuntimeError``. ``ridge`` is added to the variances.
    """
    import numpy as np

    d, k = len(columns), len(starts)
    sums = stats.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in columns], *[F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)) for c in columns]).first()
    n = sums[0] + k
    mean = (np.array(sums[1 : 1 + d]) + starts.sum(0)) / n
    deviation = np.sqrt(np.maximum((np.array(sums[1 + d :]) + (starts * starts).sum(0)) / n - mean * mean, 0.0))
    deviation[deviation < 1e-9] = 1.0
    own = (starts - mean) / deviation
    model = (np.full(k, 1.0 / k), own, np.array([0.5 * np.eye(d)] * k))
    before = None
    for _ in range(rounds):
        def sum_up(it: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            total = None
            for df in it:
                part = _moments((df.to_numpy() - mean) / deviation, model)
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"i": range(len(total)), "v": total})

        parts = stats.select(*columns).mapInPandas(sum_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = _moments(own, model)
        for r in parts:
            total[r["i"]] += r["v"]
        likelihood = total[1] / total[0]
        if before is not None and abs(likelihood - before) <= tolerance:
            return model, mean, deviation
        before = likelihood
        mass = total[2 : 2 + k] + 1e-9
        means = total[2 + k : 2 + k + k * d].reshape(k, d) / mass[:, None]
        second = total[2 + k + k * d :].reshape(k, d, d) / mass[:, None, None]
        covariances = second - means[:, :, None] * means[:, None, :]
        covariances = (covariances + covariances.transpose(0, 2, 1)) / 2
        low = np.linalg.eigvalsh(covariances)[:, 0]  # rounding may leave a flat component slightly negative
        covariances += (ridge + np.maximum(0.0, -low))[:, None, None] * np.eye(d)
        model = (np.maximum(mass / mass.sum(), 1e-12), means, covariances)
    raise RuntimeError(f"the likelihood still moves by more than {tolerance} after {rounds} rounds")


def classify_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", examples: list[tuple[str, str]] = EXAMPLES) -> DataFrame:
    """``doc_id``, the statistics, ``kind`` and ``prose_probability`` of every document that is not blank.

    The mixture is fitted by expectation-maximization on the standardized statistics of all
    documents and the inspected ``examples``, one component beginning at each; a component has the kind of the examples it
    takes, weighted by posterior, else of the nearest component that has one. ``kind`` is the one with the largest posterior,
    ``prose_probability`` the posterior of all prose components.
    """
    import numpy as np

    stats = cut(text_statistics(docs, text, key).where("not blank").drop("blank"), "statistics")
    seen = pd.DataFrame([statistics(t) for _, t in examples], columns=NAMES).to_numpy()
    model, mean, deviation = fit_mixture(stats, NAMES, seen)
    taken, _ = _posteriors((seen - mean) / deviation, model)
    votes = np.array([[taken[[i for i, (x, _) in enumerate(examples) if x == kind], c].sum() for kind in KINDS] for c in range(len(seen))])
    named = [c for c in range(len(seen)) if votes[c].sum() > 0.05]
    near = [c if c in named else min(named, key=lambda m: float(((model[1][c] - model[1][m]) ** 2).sum())) for c in range(len(seen))]
    kind_of = np.array([votes[c].argmax() for c in near])

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            p, _ = _posteriors((df[NAMES].to_numpy() - mean) / deviation, model)
            share = np.stack([p[:, kind_of == k].sum(1) for k in range(len(KINDS))], 1)
            yield df.assign(kind=[KINDS[k] for k in share.argmax(1)], prose_probability=share[:, 0])

    return stats.mapInPandas(judge, f"doc_id {dict(stats.dtypes)['doc_id']}, {', '.join(f'{n} double' for n in NAMES)}, kind string, prose_probability double")


def not_prose(classified: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents that are a list, a table or junk: the mixture's posterior of prose is under ``least``."""
    return classified.where(F.col("prose_probability") < least).select("doc_id")
