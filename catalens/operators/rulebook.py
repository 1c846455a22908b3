"""Rules of the faceted search as data: dish groups, tastes, occasions, option orders."""

from __future__ import annotations

from dataclasses import dataclass

# Conditions and reasons are SQL expressions over the entry columns of `facets.prepare_entries`.


@dataclass(frozen=True)
class Sign:
    """A trait an entry may show. `evidence` holds (SQL condition, SQL reason) pairs, the first that holds gives the reason."""

    key: str
    label: str
    evidence: tuple[tuple[str, str], ...]


def said(pattern: str, quote: tuple[str, str] = ("в описании: «", "»")) -> tuple[str, str]:
    """Evidence from the description: the first match of the pattern, quoted."""
    found = f"regexp_extract(description, r'(?U)({pattern})', 1)"
    return f"{found} <> ''", f"concat('{quote[0]}', {found}, '{quote[1]}')"


@dataclass(frozen=True)
class Rule:
    condition: str
    points: float
    reason: str


@dataclass(frozen=True)
class Dishes:
    """Rule on dish groups: holds when the item goes with any of them."""

    groups: tuple[str, ...]
    points: float


@dataclass(frozen=True)
class Likes:
    """Rule on one taste."""

    taste: str
    points: float


@dataclass(frozen=True)
class RuleBook:
    dishes: dict[str, tuple[str, tuple[str, ...]]]
    tastes: tuple[Sign, ...]
    sparkling_pattern: str
    sparkling_sugars: tuple[str, ...]
    sparkling_word: str
    types: dict[str, str]
    occasions: dict[str, tuple[str, tuple[Rule | Dishes | Likes, ...]]]
    sugar_order: tuple[str, ...]
    dish_reason: str = "сочетается с: "
    min_occasion: float = 2.0


# --- fixed values: the wine catalogue's own rules -------------------------------------------------
DRY = "sugar IN ('сухое', 'брют', 'экстра брют')"
STYLE = "concat_ws(' ', lower(color), sugar)"

WINE_RULES = RuleBook(
    dishes={
        "cheese": ("Сыры", ("Сыры",)),
        "fish": ("Рыба и морепродукты", ("Рыба и морепродукты", "Морепродукты", "Устрицы", "Блюда из рыбы")),
        "meat": ("Мясо и стейки", ("Мясо и стейки",)),
        "poultry": ("Птица", ("Блюда из птицы",)),
        "grill": ("Гриль и BBQ", ("BBQ", "Овощи гриль")),
        "snacks": ("Лёгкие закуски", ("Легкие закуски", "Лёгкие закуски", "Закуски", "Брускетты")),
        "charcuterie": ("Мясное ассорти и паштеты", ("Мясное ассорти", "Паштеты")),
        "salads": ("Салаты и овощи", ("Салаты", "Свежие овощи", "Запеченные овощи")),
        "pasta": ("Паста и пицца", ("Паста", "Пицца", "Несладкая выпечка")),
        "desserts": ("Десерты", ("Выпечка и десерты", "Десерты", "Фруктово-ягодные десерты", "Мороженое", "Шоколад")),
        "fruits": ("Фрукты", ("Фрукты",)),
        "asian": ("Азиатская и острая кухня", ("Азиатская кухня", "Острое")),
        "world": ("Кухни мира", ("Кухни народов мира", "Кавказская кухня", "Средиземноморская кухня", "Русская кухня")),
        "fastfood": ("Фастфуд", ("Фастфуд",)),
    },
    tastes=(
        Sign("fresh", "Бодрое", (said(r"свеж\w*|бодрящ\w*|цитрус\w*|кислотн\w*"),)),
        Sign("fruity", "Ягоды и фрукты", (said(r"фрукт\w*|ягод\w*|персик\w*|абрикос\w*|вишн\w*|черешн\w*|слив\w*|малин\w*|смородин\w*|яблок\w*|груш\w*"),)),
        Sign("floral", "С цветочными нотами", (said(r"цветоч\w*|цветов\w*|цветы|акаци\w*|жасмин\w*|бузин\w*|лепестк\w*|\bроз[аыу]\b"),)),
        Sign("aged", "С выдержкой", (said(r"выдерж\w*|дуб\w*|бочк\w*|ванил\w*|табак\w*|\bкож[аиу]\b"),)),
        Sign("full", "Насыщенное", (said(r"плотн\w*|насыщенн\w*|полнотел\w*|концентрир\w*|маслянист\w*"), ("alcohol >= 14", "'крепость от 14%'"))),
        Sign("light", "Лёгкое, питкое", (said(r"л[её]гк\w*|элегантн\w*|изящн\w*|воздушн\w*"), ("alcohol <= 11.5", "'крепость до 11,5%'"))),
        Sign("spicy", "Со специями", (said(r"прян\w*|специ\w*|перц\w*|гвоздик\w*|кориц\w*"),)),
    ),
    sparkling_pattern=r"игрист|шампан|перляж|брют|петнат|pet[\s-]?nat",
    sparkling_sugars=("брют", "экстра брют"),
    sparkling_word="игристое",
    types={"sparkling": "Игристое", "still": "Тихое"},
    occasions={
        "aperitif": ("Перед ужином", (
            Rule("sparkling", 2, "'игристое — классика аперитива'"),
            Rule(f"NOT sparkling AND color IN ('Белое', 'Розовое') AND {DRY}", 1.5, f"concat({STYLE}, ' — освежает перед едой')"),
            Dishes(("snacks",), 1), Likes("fresh", 0.5),
        )),
        "dinner": ("К ужину", (
            Dishes(("meat", "poultry", "fish", "pasta"), 2),
            Rule(f"NOT sparkling AND {DRY}", 1, f"concat({STYLE}, ' — не перебьёт еду')"),
        )),
        "gift": ("В подарок", (
            Rule("rating >= 4.7", 2, "concat('народный рейтинг ', replace(format_string('%.2f', rating), '.', ','))"),
            Likes("aged", 1), Rule("sparkling", 0.5, "'игристое — к празднику'"),
        )),
        "party": ("Для компании", (
            Rule("sparkling", 2, "'игристое — для компании'"), Rule("color = 'Розовое'", 1, "'розовое — нравится большинству'"),
            Rule("sugar IN ('полусухое', 'полусладкое')", 1, "concat(sugar, ' — мягкий вкус без терпкости')"),
            Dishes(("snacks", "pasta", "fastfood"), 1),
        )),
        "date": ("Романтический вечер", (
            Rule("sparkling OR color = 'Розовое'", 2, "CASE WHEN sparkling THEN 'игристое' ELSE 'розовое вино' END"),
            Dishes(("desserts", "fruits", "cheese"), 1), Likes("floral", 0.5), Likes("fruity", 0.5),
        )),
        "picnic": ("На природу", (
            Rule("color IN ('Розовое', 'Белое')", 1, "concat(lower(color), ' — хорошо охлаждённым')"),
            Likes("light", 1), Dishes(("salads", "snacks", "cheese"), 1),
        )),
        "grill": ("К мангалу", (
            Rule(f"color = 'Красное' AND {DRY}", 2, "'красное сухое — к жареному мясу'"),
            Dishes(("grill", "meat", "world"), 2), Likes("spicy", 0.5), Likes("full", 0.5),
        )),
        "dessert": ("К сладкому", (
            Rule("sugar IN ('сладкое', 'полусладкое')", 2, "concat(sugar, ' — не спорит со сладким')"),
            Dishes(("desserts", "fruits"), 2),
        )),
    },
    sugar_order=("экстра брют", "брют", "сухое", "полусухое", "полусладкое", "сладкое"),
)
# ----------------------------------------------------------------------------------------------------
