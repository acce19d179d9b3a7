"""Pages that hold template residue, printed program values, filler, error messages or script notices instead of content.

One automaton (Aho-Corasick) finds the phrases of all languages, the words of filler and the signs of placeholders and
printed values in one pass over a page's lower-cased visible text. A line or sentence with such a match is then judged by
the share of it that matches cover: one that consists of phrases is residue, one that mentions a phrase is
not; a placeholder or printed value spoils the sentence it stands in, unless the sentence speaks of it (inside code markup, or with a
word of explanation). A page is excluded when phrases cover enough of its text, or when filler, a placeholder or a
value stands anywhere in its running text.

The phrases are composed by language: what is missing with what is said of it, what is to be switched on with how that is
said, and messages of their own.

Scale: one pass over the pages, no shuffle. Defined results: null and empty contents hold no residue;
whole texts are read; repeated rows give repeated verdicts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.repair import Model, worker_model
from quillon.llm.visible import visible

# By language, things that can be missing and what is said of them; each thing is put before each saying.
MISSING = {
    "en": (
        ("page", "document", "file", "article", "section", "resource", "site", "website", "content", "record", "service", "server", "object", "url", "link", "address"),
        ("not found", "was not found", "cannot be found", "could not be found", "can't be found", "does not exist", "doesn't exist", "no longer exists", "is missing", "has gone missing", "is unavailable", "is not available",
         "is no longer available", "is temporarily unavailable", "is currently unavailable", "has been removed", "has been deleted", "has been moved or deleted", "is under construction", "is under maintenance", "is down for maintenance", "is empty", "is down"),
    ),
    "ru": (
        ("страница", "документ", "раздел", "файл", "статья", "сайт", "сервис", "сервер", "ресурс", "запись", "материал", "адрес"),
        ("не найдена", "не найден", "не найдено", "не существует", "больше не существует", "удалена", "удалён", "удален", "удалён или перемещён", "удален или перемещен", "удалена или перемещена", "недоступна", "недоступен", "временно недоступен",
         "временно недоступна", "отсутствует", "отсутствует на сервере", "в разработке", "наполняется", "на реконструкции", "на обслуживании"),
    ),
    "uk": (("сторінка", "сторінку", "документ", "розділ", "сайт", "сервіс"), ("не знайдена", "не знайдено", "не знайдений", "не існує", "видалена", "видалено", "тимчасово недоступний", "недоступна", "у розробці")),
    "de": (
        ("seite", "datei", "artikel", "dokument", "inhalt", "dienst", "server", "website"),
        ("nicht gefunden", "wurde nicht gefunden", "konnte nicht gefunden werden", "existiert nicht", "existiert nicht mehr", "ist nicht verfügbar", "nicht verfügbar", "ist nicht erreichbar", "vorübergehend nicht erreichbar", "wurde gelöscht", "ist im aufbau", "ist wegen wartung"),
    ),
    "fr": (
        ("page", "document", "fichier", "article", "contenu", "service", "serveur", "site"),
        ("introuvable", "est introuvable", "non trouvée", "non trouvé", "n'existe pas", "n'existe plus", "n’existe pas", "n’existe plus", "est indisponible", "temporairement indisponible", "est temporairement indisponible", "a été supprimée", "a été supprimé", "est en construction", "en maintenance"),
    ),
    "es": (("página", "documento", "archivo", "artículo", "contenido", "servicio", "sitio"), ("no encontrada", "no encontrado", "no existe", "ya no existe", "no está disponible", "no se ha encontrado", "no se encuentra", "ha sido eliminada", "ha sido eliminado", "en construcción", "en mantenimiento")),
    "pt": (("página", "documento", "ficheiro", "arquivo", "artigo", "conteúdo", "serviço", "site"), ("não encontrada", "não encontrado", "não existe", "não foi encontrada", "não foi encontrado", "indisponível", "não está disponível", "em construção", "em manutenção")),
    "it": (("pagina", "documento", "file", "articolo", "contenuto", "servizio", "sito"), ("non trovata", "non trovato", "non esiste", "non esiste più", "non è disponibile", "non disponibile", "è stata rimossa", "è stato rimosso", "in costruzione", "in manutenzione")),
    "pl": (("strona", "dokument", "plik", "artykuł", "serwis"), ("nie znaleziona", "nie została znaleziona", "nie istnieje", "niedostępna", "jest niedostępna", "w budowie", "w trakcie konserwacji")),
    "nl": (("pagina", "document", "bestand", "artikel", "website", "server"), ("niet gevonden", "bestaat niet", "bestaat niet meer", "is niet beschikbaar", "niet beschikbaar", "in onderhoud", "is verwijderd")),
    "tr": (("sayfa", "belge", "dosya", "içerik", "site"), ("bulunamadı", "mevcut değil", "yapım aşamasında", "kaldırıldı")),
}
# By language, how to ask for something to be switched on, and what; and what is said of scripts.
SCRIPTS = {
    "en": (("enable", "turn on", "switch on", "activate", "allow", "re-enable", "enabling"), ("javascript", "scripts", "scripting", "cookies", "javascript and cookies", "scripts and cookies", "scripting and cookies"),
           ("javascript is required", "javascript is disabled", "javascript is turned off", "javascript is not enabled", "javascript must be enabled", "requires javascript", "require javascript", "needs javascript", "needs scripts to run", "need to be enabled", "without javascript", "without javascript enabled",
            "turn scripting on", "turn scripting and cookies on", "turn javascript on", "does not support javascript", "doesn't support javascript", "does not run scripts", "cannot be shown without them", "checking your browser", "to run this app", "work properly", "doesn't work", "does not work")),
    "ru": (("включите", "включить", "разрешите", "разрешить", "активируйте", "необходимо включить", "нужно включить", "требуется"), ("javascript", "скрипты", "сценарии", "скрипты и куки", "поддержку javascript", "cookies", "куки"),
           ("нужны сценарии", "нужны скрипты", "нужен javascript", "без скриптов не работает", "без javascript не работает", "javascript отключён", "javascript отключен", "javascript выключен", "не выполняет сценарии", "не поддерживает javascript", "проверяем браузер")),
    "uk": (("увімкніть", "увімкнути", "дозвольте", "потрібен"), ("javascript", "скрипти", "cookies"), ("javascript вимкнено",)),
    "de": (("aktivieren sie", "bitte aktivieren sie", "erlauben sie", "schalten sie"), ("javascript", "skripte", "cookies", "skripte und cookies"), ("javascript ist deaktiviert", "javascript wird benötigt", "benötigt javascript", "ohne javascript", "javascript muss aktiviert sein")),
    "fr": (("activez", "activer", "veuillez activer", "autorisez"), ("javascript", "les scripts", "les cookies", "scripts"), ("javascript est désactivé", "javascript est requis", "nécessite javascript", "sans javascript")),
    "es": (("active", "activar", "habilite", "habilitar", "permita"), ("javascript", "scripts", "cookies"), ("javascript está desactivado", "requiere javascript", "es necesario activar javascript", "sin javascript")),
    "pt": (("ative", "ativar", "habilite", "habilitar"), ("javascript", "scripts", "cookies"), ("javascript está desativado", "requer javascript", "sem javascript")),
    "it": (("attiva", "attivare", "abilita", "abilitare"), ("javascript", "gli script", "i cookie"), ("javascript è disabilitato", "richiede javascript", "senza javascript")),
    "pl": (("włącz", "włączyć", "zezwól na"), ("javascript", "skrypty", "obsługę javascript"), ("javascript jest wyłączony", "wymaga javascript")),
    "nl": (("schakel", "activeer", "zet"), ("javascript in", "javascript aan", "scripts in"), ("javascript is uitgeschakeld", "javascript is vereist", "vereist javascript")),
    "tr": (("etkinleştirin", "lütfen"), ("javascript", "javascript'i etkinleştirin"), ("javascript gerekli", "javascript devre dışı")),
}
# By language, messages and filler that say enough by themselves.
MESSAGES = {
    "en": (
        "internal server error", "internal error", "http error", "server error", "application error", "bad request", "bad gateway", "gateway timeout", "gateway time-out", "service unavailable", "the service is unavailable", "temporarily unavailable", "too many requests", "too many requests to",
        "access denied", "permission denied", "access is denied", "you are not allowed", "you don't have permission", "is forbidden", "access to", "not authorized", "session expired", "your session has expired", "your session with", "please sign in again", "sign in once more", "please log in again",
        "fatal error", "stack trace", "uncaught exception", "unhandled exception", "parse error", "syntax error", "warning: undefined", "undefined variable", "undefined index", "traceback (most recent call last)", "database error", "error establishing a database connection", "database connection failed", "while talking to the database",
        "the page you requested", "the requested url", "the page you are looking for", "page you were looking for", "sorry, the page", "sorry, the document", "sorry, we", "oops", "something went wrong", "an error occurred", "an error has occurred", "nothing was found at", "nothing here at", "return to the home page", "go back to the home page", "go to the home page",
        "try again later", "come back later", "is down for maintenance", "has gone missing", "has gone missing from", "is under construction", "coming soon", "content coming soon", "under maintenance", "under construction", "scheduled maintenance", "connection refused", "connection timed out", "took too long to respond", "error code",
        "your text goes here", "your text goes here for", "text goes here", "insert copy here", "insert text here", "sample heading", "sample text", "dummy copy", "dummy text", "placeholder text", "replace me", "replace me later", "test test test", "test test asdf", "asdf asdf", "qwerty qwerty", "this section is empty", "text of the section goes here", "enter your text", "add your content", "lorem ipsum",
    ),
    "ru": (
        "внутренняя ошибка", "внутренняя ошибка сервера", "внутренняя ошибка при обращении к базе", "ошибка сервера", "ошибка базы данных", "ошибка подключения к базе данных", "критическая ошибка", "фатальная ошибка", "не удалось открыть", "временно недоступен", "отсутствует на сервере", "ведутся работы", "технические работы", "доступ к", "доступ запрещён", "доступ запрещен",
        "доступ ограничен", "время сеанса", "сеанс истёк", "войдите снова", "слишком много запросов", "слишком много запросов к", "повторите позже", "попробуйте позже", "не ответил вовремя", "не отвечает", "ничего не нашлось по адресу", "вернитесь на главную", "перейти на главную", "запрошенный документ", "запрошенная страница",
        "извините, запрошенный документ", "что-то пошло не так", "произошла ошибка", "упс", "похоже, раздел", "похоже, страница", "скоро здесь будет", "здесь будет текст", "здесь будет текст раздела", "текст появится позже", "вставьте текст", "вставьте сюда текст", "пример заголовка", "пример текста", "текст-рыба", "рыба-текст", "заполнить позже",
        "тест тест тест", "йцукен йцукен фыва", "йцукен", "страница в разработке", "раздел в разработке", "показать нельзя",
    ),
    "uk": ("внутрішня помилка", "помилка сервера", "доступ заборонено", "щось пішло не так", "спробуйте пізніше", "технічні роботи", "тут буде текст"),
    "de": (
        "interner serverfehler", "interner fehler", "serverfehler", "zugriff auf", "zugriff verweigert", "ist abgelaufen", "sitzung ist abgelaufen", "bitte erneut anmelden", "wartungsarbeiten", "wegen wartung", "später erneut versuchen", "zu viele anfragen", "ein fehler ist aufgetreten", "etwas ist schiefgelaufen", "nicht erreichbar",
        "beispieltext", "blindtext", "platzhalter", "hier steht später text", "hier steht bald", "hier steht bald der text von", "hier entsteht", "bitte ersetzen", "ihr text hier", "demnächst verfügbar",
    ),
    "fr": (
        "erreur interne", "erreur interne du serveur", "erreur du serveur", "accès refusé", "accès interdit", "a expiré", "session a expiré", "veuillez vous reconnecter", "réessayez plus tard", "trop de requêtes", "une erreur est survenue", "une erreur s'est produite", "en maintenance",
        "texte d'exemple", "texte factice", "texte à venir", "votre texte ici", "ici bientôt", "bientôt le texte de", "bientôt disponible", "à remplacer", "page introuvable",
    ),
    "es": ("error interno", "error interno del servidor", "error del servidor", "acceso denegado", "acceso prohibido", "sesión ha caducado", "sesión ha expirado", "inténtelo más tarde", "inténtalo más tarde", "demasiadas solicitudes", "ha ocurrido un error", "algo salió mal", "próximamente", "su texto aquí", "tu texto aquí", "texto de ejemplo"),
    "pt": ("erro interno", "erro interno do servidor", "acesso negado", "sessão expirou", "tente novamente mais tarde", "ocorreu um erro", "algo deu errado", "em breve", "seu texto aqui", "texto de exemplo"),
    "it": ("errore interno", "errore interno del server", "accesso negato", "sessione è scaduta", "riprova più tardi", "si è verificato un errore", "qualcosa è andato storto", "prossimamente", "il tuo testo qui", "testo di esempio"),
    "pl": ("wewnętrzny błąd serwera", "błąd serwera", "odmowa dostępu", "dostęp zabroniony", "sesja wygasła", "spróbuj ponownie później", "wystąpił błąd", "coś poszło nie tak", "wkrótce", "tutaj wpisz tekst"),
    "nl": ("interne serverfout", "toegang geweigerd", "sessie is verlopen", "probeer het later opnieuw", "er is een fout opgetreden", "binnenkort beschikbaar", "voorbeeldtekst"),
    "tr": ("sunucu hatası", "erişim engellendi", "bir hata oluştu", "daha sonra tekrar deneyin", "çok yakında"),
}
# Words and sayings that say nothing by themselves; they count beside a phrase that does.
WEAK_WORDS = (
    "minutes seconds error code wait so denied forbidden upstream expired please sorry later again requested browser your continue "
    "ошибка адрес сервис сервер код поэтому секунд истекло шлюз фыва запрещён запрещен пожалуйста браузер сторінка помилка "
    "fehler um verweigert seite erreur refusé introuvable indisponible error página erro errore pagina strona aby błąd sayfa hata"
)
WEAK_SAYINGS = (
    "come back in|to view|to open|on line|the server at|while answering|not found|has been removed|you asked for|did not reply|cannot open|cannot be shown|before you reach|your browser|your session|has expired|no longer|to continue|"
    "для просмотра|чтобы открыть|чтобы продолжить|это займёт|не найден|не найдена|время сеанса|в строке|в настройках браузера|ваш браузер|перед входом на|не ответил|больше не существует|будь ласка|"
    "zu sehen|zugriff auf|ihre sitzung|nicht gefunden|die seite|diese seite|accès à|pour afficher|votre session|la page|cette page|la página|esta página|para ver|por favor|a página|per favore|la pagina|questa pagina|ta strona|deze pagina"
)


def _phrases() -> dict[str, bool]:
    """All phrases, with whether they say enough by themselves."""
    weak = {*WEAK_WORDS.split(), *WEAK_SAYINGS.split("|")}
    out = dict.fromkeys(weak, False)
    for things, sayings in MISSING.values():
        out |= dict.fromkeys((s for s in sayings if " " not in s or s in weak), False)
        out |= {f"{a} {b}": True for a in things for b in sayings}
    for verbs, things, sayings in SCRIPTS.values():
        out |= {f"{a} {b}": True for a in verbs for b in things} | dict.fromkeys(sayings, True)
    for messages in MESSAGES.values():
        out |= dict.fromkeys(messages, True)
    return out


# The words of the usual Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porta cursus nibh viverra".split()
)
NAME = r"(?:\w+\.)*\w+"
#: The forms of unfilled fields and of printed program values.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{NAME}\s*(?:\|\s*\w+\s*)*\}}?\}}\}}|\{{%-?\s*\w+[^%{{}}\n]{{0,60}}%\}}|<%[=-]?\s*{NAME}\s*%>|<\?(?:=|php)\s*(?:echo\s+)?\$?{NAME}\s*;?\s*\?>|\[\[\s*{NAME}\s*\]\]|\{{!\s*{NAME}\s*!\}}|\[%\s*{NAME}\s*%\]"
    rf"|@@{NAME}@@|%%{NAME}%%|(?<!\w)__[A-Za-z][A-Za-z.]*(?:_[A-Za-z.]+)*__(?!\w)|(?<![\w&])#[A-Za-z][A-Za-z_.]*#(?!\w)|\$\{{\s*{NAME}\s*\}}|(?<![{{\w$])\{{[A-Za-z][A-Za-z_.]*\}}(?!\}})|%\({NAME}\)s"
)
PRINTED = re.compile(
    r"\[object \w+\]|\bundefined undefined\b|\bnull null\b|\bNone None\b|\bNaN\s?[₽$€%]|[$€]\s?NaN\b|\bNaN\.undefined\b|\bArray \( \[0\] =>|\bfunction \(\) \{ \[native code\] \}|\bFIRSTNAME LASTNAME\b|\bVORNAME NACHNAME\b|\bИМЯ ФАМИЛИЯ\b|\bPRENOM NOM\b|\bjava\.lang\.\w+Exception\b|#<\w+:0x[0-9a-f]+>"
)
# Signs, in lower case, without which neither pattern can match.
SIGNS = ("{", "<%", "<?", "[[", "[%", "@@", "%%", "__", "#", "%(", "[object", "undefined", "null null", "none none", "nan", "array (", "function ()", "firstname", "vorname", "prenom", "имя", "java.")
SPOKEN = re.compile(r"<(code|pre|kbd|samp)\b[^>]*>.*?</\1\s*>", re.S | re.I)
# Words of sentences that explain such things.
EXPLAINS = re.compile(r"\b(?:variable|template|placeholder|explains?|lesson shows|is replaced|stands for|syntax|переменн\w+|шаблонизатор\w*|заменяется|объясняет|показывает это|подстав\w+|erklärt|platzhalter|variable|vorlage|ersetzt wird|explique|modèle|est remplacé\w*)\b", re.I)
END = re.compile(r"(?<=[.!?…])\s+")
WORD = re.compile(r"[^\W\d_]+")
DATA = re.compile(r"\S*(?:[/\d@]|\w\.\w)\S*")
CHROME = re.compile(r"<(noscript|nav|aside|footer|dialog)\b[^>]*>.*?</\1\s*>", re.S | re.I)


@lru_cache(1)
def automata():
    """The automaton of all phrases, and that of what makes a line worth a look: telling phrases, filler words and signs."""
    import ahocorasick

    every, telling = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, says in _phrases().items():
        every.add_word(p, (len(p), says))
        if says:
            telling.add_word(p, len(p))
    sayings = (s for _, own in MISSING.values() for s in own if " " in s)  # what is missing may be an address
    for w in (*(w for w in LATIN if len(w) >= 5), *SIGNS, *sayings):
        telling.add_word(w, len(w))
    every.make_automaton()
    telling.make_automaton()
    return every, telling


def inside_word(text: str, start: int, end: int) -> bool:
    """Whether a match begins or ends within a word."""
    return (start > 0 and text[start].isalnum() and text[start - 1].isalnum()) or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def phrase_cover(line: str) -> float:
    """The share of a line's words that phrases cover; 0 unless a phrase that says something is among them.

    Addresses and numbers are what phrases are filled with: they are left out first. A single word left over (a
    site's name) doesn't count either."""
    low = " ".join(DATA.sub(" ", line.lower()).split())
    spans, strong = [], False
    for end, (n, says) in automata()[0].iter(low):
        if inside_word(low, end + 1 - n, end + 1):
            continue
        spans.append((end + 1 - n, end + 1))
        strong |= says
    if not strong:
        return 0.0
    keep, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            keep.append(low[at:a])
        at = max(at, b)
    keep.append(low[at:])
    rest = len(WORD.findall(" ".join(keep)))
    return 1.0 if rest <= 1 else max(0.0, 1 - rest / max(len(WORD.findall(low)), 1))


def filler(line: str) -> bool:
    """Whether a line is Latin filler: five words or more, over half of them of its vocabulary."""
    w = WORD.findall(line.lower())
    return len(w) >= 5 and sum(x in LATIN for x in w) > 0.6 * len(w)


def sentences(line: str) -> list[str]:
    return END.split(line)


def spoiled(sentence: str) -> bool:
    """Whether a placeholder or a printed value stands in a sentence that does not explain it."""
    return bool((PLACEHOLDER.search(sentence) or PRINTED.search(sentence)) and not EXPLAINS.search(sentence))


def judge_line(line: str, line_cover: float = 0.5) -> tuple[int, int]:
    """(words that phrases cover, words that filler, placeholders and values spoil) of a line with a match.

    A line of which phrases cover enough counts as a whole; else each of its sentences is judged."""
    parts = sentences(line)
    phrased = len(line.split()) if phrase_cover(line) >= line_cover else sum(len(s.split()) for s in parts if phrase_cover(s) >= line_cover) if len(parts) > 1 else 0
    return phrased, len(line.split()) if filler(line) else sum(len(s.split()) for s in parts if filler(s) or spoiled(s))


def residue_share(content: str | None, model: Model | None = None, line_cover: float = 0.5) -> tuple[float, bool]:
    """(share of the page's words that residue covers, whether filler, placeholders or values stand in running text)."""
    if not content:
        return 0.0, False
    if model is not None:
        content = model.restore(content)[1]
    return residue_of(content, visible(content), line_cover)


def residue_of(content: str, text: str, line_cover: float = 0.5) -> tuple[float, bool]:
    """The same of a restored content and its visible text."""
    if any(x in content for x in ("<code", "<pre", "<kbd", "<samp")):
        text = visible(SPOKEN.sub(lambda m: " " + "\n" * m[0].count("\n"), content))
    if CHROME.search(content):  # a notice in the chrome does not stand in place of content
        body = visible(CHROME.sub(lambda m: " " + "\n" * m[0].count("\n"), content))
        text = body if WORD.search(body) else text
    low = text.lower()
    if len(low) != len(text):  # a letter that is longer in lower case: positions of the one don't fit the other
        text = low
    phrased, bad, seen = 0, 0, -1
    for end, n in automata()[1].iter(low):
        if end <= seen or inside_word(low, end + 1 - n, end + 1):
            continue
        start = low.rfind("\n", 0, end) + 1
        seen = low.find("\n", end)
        seen = len(low) if seen < 0 else seen
        p, b = judge_line(text[start:seen], line_cover)
        phrased += p
        bad += b
    return ((phrased + bad) / len(text.split()) if phrased or bad else 0.0), bad > 0


def find_residue(pages: DataFrame, model: Model, page: str = "page_id", content: str = "content", min_share: float = 0.03) -> DataFrame:
    """(page, share, in_text) of the pages to exclude: residue covers at least the share of the text, or stands in running text.

    Text garbled by a wrong encoding is restored by the model first."""
    shared = pages.sparkSession.sparkContext.broadcast(model.shared())
    rows = pages.select(F.col(page).alias("page"), F.col(content).alias("content")).filter("content is not null and content <> ''")

    def judge(batches):
        m = worker_model(shared)
        for pdf in batches:
            v = [residue_share(c, m) for c in pdf["content"]]
            out = pd.DataFrame({"page": pdf["page"], "share": [x for x, _ in v], "in_text": [y for _, y in v]})
            yield out[(out["share"] >= min_share) | out["in_text"]]

    return rows.mapInPandas(judge, f"page {rows.schema['page'].dataType.simpleString()}, share double, in_text boolean")
