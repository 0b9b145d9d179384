"""What is said to people: names of platforms, reasons of issues, errors and readiness in plain words, abbreviations written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plural
from ..functions.urls import domain
from .projections import BLOCKED_STATUS, error_kind

#: Names of platforms by site.
PLATFORMS = {
    "ozon.ru": "Ozon", "wildberries.ru": "Wildberries", "market.yandex.ru": "Яндекс Маркет", "megamarket.ru": "Мегамаркет", "irecommend.ru": "iRecommend", "med-otzyv.ru": "Мед-отзыв", "otzovik.com": "Отзовик", "otzyv.pro": "Отзыв.pro", "vseotzyvy.ru": "Все отзывы",
    "otzyvru.com": "ОтзывРу", "pravogolosa.net": "Право голоса", "ru.otzyv.com": "Otzyv.com", "uteka.ru": "Ютека", "megapteka.ru": "Мегаптека", "medum.ru": "Medum", "eapteka.ru": "ЕАПТЕКА", "polza.ru": "POLZAru", "asna.ru": "АСНА", "farmlend.ru": "Фармленд",
    "okapteka.ru": "ОК Аптека", "rigla.ru": "Ригла", "zdravcity.ru": "Здравсити", "apteka.ru": "Apteka.ru", "nfapteka.ru": "Надежда-Фарм", "budzdorov.ru": "Будь Здоров", "etabl.ru": "eTabl.ru", "apteka-april.ru": "Апрель",
}
#: Short spellings of a market's titles, and what they stand for.
ABBREVIATIONS = {r"р[.\s-]*р(?=\s|$)": "раствор", r"д\s*/\s*вн\.?\s*при[её]ма(?![\p{L}\p{N}])": "для приема внутрь", r"капс\.?(?![\p{L}\p{N}])": "капсулы"}


def platform_labels(sites: DataFrame, column: str) -> DataFrame:
    """Adds `label`: the platform's name, or the site in its normal form where it has none."""
    names = sites.sparkSession.createDataFrame(list(PLATFORMS.items()), "_site string, _label string")
    return sites.withColumn("_site", domain(F.col(column))).join(F.broadcast(names), "_site", "left").withColumn("label", F.coalesce("_label", "_site")).drop("_site", "_label")


def written_out(title: Column) -> Column:
    """A title with its abbreviations of forms written out; nothing is added that it does not say."""
    for short, long_ in ABBREVIATIONS.items():
        title = F.regexp_replace(title, rf"(?iu)(?<![\p{{L}}\p{{N}}]){short}", long_)
    return F.trim(F.regexp_replace(title, r"\s+", " "))


# Issues and errors

UNFINISHED = "Не удалось завершить проверку."
#: What is said of an issue, by kind, after what it is about.
ISSUES = {"quota": "исчерпан доступный лимит сбора.", "mode": "площадка пока не поддерживается в бесплатном режиме.", "blocked": "площадка временно ограничила сбор. Повторите позже.", "parser": "площадка изменила страницу и требует повторной настройки.", "review": "карточка требует проверки."}
#: What is said of an error, by kind, and of one of no kind, by what was being done.
ERRORS = {"offline": "Нет связи с сервисом. Проверьте интернет и повторите.", "quota": "Доступный лимит сбора исчерпан. Повторите позже или временно уберите эту площадку.", "blocked": "Площадка временно ограничила автоматический сбор. Повторите позже.", "parser": "Площадка изменила страницу. Её нужно повторно проверить перед публикацией."}
ACTIONS = {
    "load": "Не удалось открыть сервис. Обновите страницу через минуту.", "restore": "Не удалось восстановить последний запуск. Можно начать новый сбор.", "start": "Не удалось запустить сбор. Проверьте настройки и повторите.", "retry": "Не удалось повторить проблемные площадки. Попробуйте ещё раз позже.",
    "review": "Не удалось сохранить подтверждение. Повторите ещё раз.", "profile": "Не удалось сохранить правило площадки. Проверьте выбор и повторите.", "publish": "Не удалось обновить Google Таблицу. Проверьте доступ «Редактор» по ссылке и повторите.",
}
#: Words that tell the kinds of messages, machine words that nobody should read, and names of states that are cut out.
WORDS = {
    "mode": ["blocked free mode"], "blocked": ["captcha", "капч", "blocked", "заблокирован", "ограничил сбор", "ограничила сбор", "ограничили сбор", "ограничил доступ", "ограничила доступ", "ограничили доступ"],
    "parser": ["parser changed", "парсер", "селектор"], "review": ["needs review"], "offline": ["failed to fetch", "network", "fetch failed", "timeout", "timed out", "econn", "socket hang up"],
    "machine": ["/api/", "syntaxerror", "unexpected token", "internal server", "service unavailable", "status code", "typeerror"], "states": ["quota_exceeded", "parser_changed", "needs_review", "blocked", "not_found"],
}
LONGEST = 240


def says(message: Column, kind: str) -> Column:
    """Whether one of the kind's words stands in the message; words may be joined by underscores and dashes."""
    plain = F.regexp_replace(F.lower(message), r"[\s_-]+", " ")
    out = F.lit(False)
    for words in WORDS[kind]:
        out = out | F.contains(plain, F.lit(words))
    return out


def kind_of(message: Column) -> Column:
    """quota, mode, blocked, parser, review, or null.

    A bare number is an answer's status only where no state is named: beside one it may be an identifier.
    """
    statuses, states = "|".join(str(s) for s in BLOCKED_STATUS if s in (429, 498)), "|".join(WORDS["states"])
    status = message.rlike(rf"(?i)\bHTTP\s+(?:{statuses})\b") | (message.rlike(rf"\b(?:{statuses})\b") & ~message.rlike(rf"(?i)\b(?:{states})\b"))
    parser = says(message, "parser") | message.rlike(r"(?iu)структур\S*\s+(измен|обнов)")
    return F.when(error_kind(message) == "quota_exceeded", "quota").when(says(message, "mode"), "mode").when(says(message, "blocked") | status | message.rlike(r"(?i)\bpow\b"), "blocked").when(parser, "parser").when(says(message, "review"), "review")


def issue_text(message: Column) -> Column:
    """An issue in plain words, behind the site and brand that it is about."""
    raw = F.trim(message)
    scope = F.regexp_extract(raw, r"^([^:]{1,120}):\s*", 1)
    prefix = F.when(scope != "", F.concat(F.trim(scope), F.lit(": "))).otherwise("")
    said = F.element_at(F.create_map(*[F.lit(v) for item in ISSUES.items() for v in item]), kind_of(raw))
    states = "|".join(WORDS["states"])
    left = F.trim(F.regexp_replace(F.regexp_replace(raw, rf"(?i)\b(?:{states})\s*:?\s*", ""), r"\s{2,}", " "))
    return F.when(F.coalesce(raw, F.lit("")) == "", UNFINISHED).when(said.isNotNull(), F.concat(prefix, said)).when(left == "", UNFINISHED).otherwise(left)


def error_text(message: Column, action: Column) -> Column:
    """An error in plain words, by its kind, else by what was being done; machine words and endless texts are never shown."""
    raw = F.trim(message)
    fallback = F.element_at(F.create_map(*[F.lit(v) for item in ACTIONS.items() for v in item]), action)
    kind = F.when(says(raw, "offline"), "offline").otherwise(F.nullif(kind_of(raw), F.lit("review")))
    said = F.element_at(F.create_map(*[F.lit(v) for item in (ERRORS | {"mode": ERRORS["blocked"]}).items() for v in item]), kind)
    machine = says(raw, "machine") | raw.rlike(r"(?i)\bat\s+\w+\s*\(|\b[a-z]+_[a-z_]+\b") | (F.length(raw) > LONGEST)
    return F.when(F.coalesce(raw, F.lit("")) == "", fallback).when(said.isNotNull(), said).when((action == "publish") | machine, fallback).otherwise(raw)


def observation_issue(reviews: Column, rating: Column, granularity: Column, confidence: Column) -> Column:
    """Why a card waits for a person, the gravest reason first."""
    vague = granularity.isNull() | (granularity == "unresolved") | ~F.coalesce(confidence == "exact", F.lit(False))
    return (
        F.when(granularity == "not_product", "Не является товаром").when(reviews.isNull(), "Отзывы / оценки не получены").when((reviews > 0) & rating.isNull(), "Рейтинг не получен")
        .when((reviews == 0) & rating.isNotNull(), "Проверьте число отзывов / оценок").when(vague, "Не хватает данных о варианте").otherwise("Нужно сверить карточку")
    )


def readiness(settings: dict[str, Column], max_checks: int = 600) -> Column:
    """What a request still lacks, in the order of the form; settings: sheet, sheet_valid, month, region_valid, domains, brands."""
    n, m = settings["domains"], settings["brands"]
    ready = F.concat(F.lit("Готово: "), n.cast("string"), F.lit(" "), plural(n, "площадка", "площадки", "площадок"), F.lit(" × "), m.cast("string"), F.lit(" "), plural(m, "бренд", "бренда", "брендов"), F.lit("."))
    missing = [(settings["sheet"].isNull(), "Добавьте ссылку на Google Таблицу."), (~settings["sheet_valid"], "Исправьте ссылку на Google Таблицу."), (settings["month"].isNull(), "Выберите месяц отчёта."), (~settings["region_valid"], "Укажите регион."), (n == 0, "Добавьте хотя бы одну площадку."), (m == 0, "Добавьте хотя бы один бренд."), (n * m > max_checks, f"Слишком много проверок — максимум {max_checks}.")]
    out = None
    for lacks, said in missing:
        out = F.when(lacks, said) if out is None else out.when(lacks, said)
    return out.otherwise(ready)
