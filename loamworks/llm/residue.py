"""Template residue, filler, error messages and requests to allow scripts (problem 8).

Each text is cut into passage windows (lines and sentences). For every window labelled
exemplars are retrieved through an inverted index, and the share of the window's TF-IDF
weight that the retrieved exemplars contain is its coverage. Document frequencies are
counted over all documents. A document is found if a template field stands where a value
should, or if windows of high coverage are all it holds besides a name, menu or footer.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.llm.lookalike import canonical_batch, slices

COVERAGE = 0.62  # share of a window's weight from which it counts as residue
PRESENCE = 0.75  # share of an exemplar's weight that must stand in the window for it to be retrieved
VOCABULARY = 0.8  # share of a window's weight in the words of one kind's exemplars from which it counts, whatever their order
LOREM_LINES = 3  # exemplars of filler without an order, which are retrieved by any of their words

# The labelled exemplars, whole messages in their public wordings, one to a line.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
vestibulum pellentesque vivamus curabitur suspendisse praesent maecenas phasellus aenean donec fusce integer etiam quisque morbi proin nunc lacus ligula sapien tortor turpis ultrices ultricies varius viverra volutpat vulputate felis arcu purus urna porta odio justo massa mollis nibh nullam ornare risus tempus vitae mattis lectus dapibus tincidunt sagittis cursus semper rutrum
at vero eos et accusam et justo duo dolores et ea rebum stet clita kasd gubergren no sea takimata sanctus est sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
the quick brown fox jumps over the lazy dog
your headline goes here
your text goes here
your content goes here
your title here
your name here
add your text here
add a heading
add your own text and edit me
this is a paragraph click here to add your own text and edit me
i'm a paragraph click here to add your own text
click here to edit this text
enter your text here
type something here
type your text here
write something here
write your story here
insert description here
insert text here
insert your text here
insert title here
put your text here
replace this text with your own
replace this with your own content
content coming soon
content to follow
text to follow
text to come
more to come
details to follow
description coming soon
coming soon
page under construction
this page is under construction
this section is under construction
todo write this section
todo add text
to be written
to be announced
to be added
tbd
this is a placeholder
this is a placeholder paragraph
placeholder text for this section
this is placeholder text
sample text for this block
this is a sample text
this is sample content
this is dummy text
this is an example page it's different from a blog post because it will stay in one place
welcome to wordpress this is your first post edit or delete it then start writing
hello world
a short description of this page
summary of the item goes here
subtitle goes here
caption text
body text
heading
votre texte ici
insérez votre texte ici
saisissez votre texte ici
le texte viendra ici
texte à venir
contenu à venir
titre à remplacer
texte à remplacer
texte de remplacement
exemple de texte
page en construction
description à compléter
su texto va aquí
escriba su texto aquí
inserte su texto aquí
inserte aquí la descripción
texto de ejemplo
texto pendiente
título pendiente
contenido próximamente
aquí va el texto
página en construcción
hier steht ihr text
hier kommt der text hin
hier text eingeben
fügen sie hier ihren text ein
überschrift hier einfügen
text folgt
inhalt folgt
inhalt folgt in kürze
beschreibung folgt
platzhalter für die beschreibung
dies ist ein platzhalter
platzhaltertext
beispieltext
dies ist ein blindtext
seite im aufbau
"""
# Words of the same filler that are words of living languages too; they count only beside LOREM_LEAST other words of it.
LOREM_SHORT = "a ab ac ad at aut cum de do dolorem ea eget error est et eu ex id in no non qui sea sit sunt ut".split()
LOREM_LEAST = 2
ERRORS = """
not found
page not found
file not found
not found the requested url was not found on this server
the requested url was not found on this server that's all we know
the page you are looking for does not exist
the page you were looking for doesn't exist you may have mistyped the address or the page may have moved
the page you are looking for might have been removed had its name changed or is temporarily unavailable
the page you asked for could not be found
the page you requested could not be found please check the address and try again
the resource you requested could not be found
the file you are trying to open no longer exists
sorry this page isn't available the link you followed may be broken or the page may have been removed
sorry that page can't be found
oops that page can't be found it looks like nothing was found at this location maybe try a search
oops something went wrong
this page does not exist any more
this content is no longer available here
this content isn't available right now
this page has been moved or deleted
this record is not available in your area
this video is unavailable
this content is not available in your country or region
this link has expired
this link is no longer valid
cannot get the file
forbidden
forbidden you don't have permission to access this resource on this server
you do not have permission to view or open this page
you are not authorized to access this page
access denied
access to this resource has been denied
access to this page is blocked by the site owner
your account has been suspended
this account has been disabled or closed
authorization required
please log in to continue
you must be logged in to see this page sign in again
your session has expired please sign in again
your session has ended please sign in again
your session has timed out please reload the page
your request has been blocked
sorry you have been blocked you are unable to access this website
this website is using a security service to protect itself from online attacks
internal server error
internal error
an internal error occurred
the server encountered an internal error or misconfiguration and was unable to complete your request
the server met an unexpected condition
an unexpected error has occurred please try again later
the website encountered an unexpected error
an error occurred while processing your request
there has been a critical error on this website
something went wrong on our side please try again in a few minutes
sorry we could not process the form
something went wrong while displaying this webpage
we're sorry but something went wrong
we apologise for the inconvenience
application error a client side exception has occurred
bad request your browser sent a request that this server could not understand
the request was refused or rejected by the server
bad gateway
the proxy server received an invalid response from an upstream server
upstream request timeout
upstream not ready
gateway timeout the upstream server did not respond in time
gateway timed out
connection timed out
connection refused
connection reset by peer
the connection was reset
the connection has timed out
the server at this address is taking too long to respond
the request took too long and was stopped
the request took too long to answer
request timeout
this site can't be reached
this page isn't working
took too long to respond
refused to connect
check your internet connection
check the proxy and the firewall
check if there is a typo in the address
hmm we're having trouble finding that site
unable to connect
we can't connect to the server
secure connection failed
your connection is not private
could not be reached
no route to host
service unavailable
the server is temporarily unable to service your request due to maintenance downtime or capacity problems
the service is temporarily unavailable
the service is unavailable
the service is taking a break try again later
the server is too busy at the moment
our server is overloaded
the website is temporarily unable to handle your request
we are down for maintenance
the site is closed for maintenance and upkeep
we are currently performing scheduled maintenance we'll be back soon
briefly unavailable for scheduled maintenance check back in a minute
too many requests
too many requests from your address
you have sent too many requests please slow down and wait
rate limit exceeded
error establishing a database connection
could not connect to the database
the database refused the connection
web server is down
checking your browser before you continue
checking your browser before accessing the site please wait
verify you are human by completing the action below
please confirm that you are not a robot
please complete the security check to access the site
our systems have detected unusual traffic from your computer network
just a moment
go back to the start page
go back to the home page
return to the previous page
try again
please try again
refresh the page
reload the page and try again
check the address and try again
if this goes on tell the site owner
if the problem persists please contact the site owner or administrator
error code
error code message
error message
error number
error
code
http
http error
status code
status path
reference
reference number
request id
incident number at
incident no
ray id
your ip address
timestamp
error code message trace
error true message not found
error id url method path type title detail instance
nginx
openresty
apache server at port
cloudflare
microsoft iis
gateway
server
sorry
oops
notice
attention
warning
java lang nullpointerexception at
exception in thread main java lang
caused by java io ioexception
java lang runtimeexception at org apache main java native method
at loader read loader java
at main main java
traceback most recent call last file line in load
file line in module
file run py line in read table
keyerror
valueerror invalid literal for int with base
attributeerror object has no attribute
typeerror object is not callable
indexerror list index out of range
modulenotfounderror no module named
typeerror cannot read properties of undefined
referenceerror is not defined
fatal error uncaught error call to undefined function in php on line
warning undefined index in php on line
warning undefined variable in inc on line
warning undefined array key in page php on line
warning cannot modify header information headers already sent by
warning cannot send headers in page on line
parse error syntax error unexpected in on line
stack trace
you have an error in your sql syntax check the manual that corresponds to your server version for the right syntax to use near at line
sql error column does not exist at character
sql error relation does not exist at character
unknown column in field list
sqlstate
segmentation fault core dumped
permission denied
no such file or directory
page introuvable
cette page n existe plus
cette page n existe pas ou a été déplacée
la page que vous cherchez n existe pas
la page demandée est introuvable
erreur interne du serveur
une erreur est survenue veuillez réessayer plus tard
une erreur inattendue s est produite
accès refusé
accès interdit
vous n avez pas accès à ce contenu
vous n êtes pas autorisé à consulter cette page
le serveur ne répond pas
le service est indisponible pour le moment
service temporairement indisponible
votre session a expiré
ce lien a expiré
site en maintenance
trop de requêtes
désolé
réessayez plus tard
revenir à la page d accueil
erreur
página no encontrada
esta página ya no existe
la página que busca no existe o ha sido movida
no se ha encontrado la página solicitada
error interno del servidor
se ha producido un error inténtelo de nuevo más tarde
acceso denegado
no tiene permiso para ver esto
no tiene permiso para acceder a esta página
el servidor no responde
el servicio no está disponible
servicio no disponible temporalmente
su sesión ha caducado
este enlace ha caducado
sitio en mantenimiento
demasiadas solicitudes
lo sentimos
inténtelo de nuevo
volver a la página de inicio
aviso
seite nicht gefunden
leider wurde die seite nicht gefunden
die angeforderte seite wurde nicht gefunden
die gesuchte seite existiert nicht oder wurde verschoben
diese seite gibt es nicht mehr
interner serverfehler
ein unerwarteter fehler ist aufgetreten
es ist ein fehler aufgetreten bitte versuchen sie es später erneut
zugriff verweigert
ihnen fehlt die berechtigung
sie haben keine berechtigung diese seite aufzurufen
der server antwortet nicht
der server ist überlastet
der dienst ist zurzeit nicht erreichbar
der dienst ist vorübergehend nicht verfügbar
ihre sitzung ist abgelaufen
der link ist abgelaufen
wartungsarbeiten
zu viele anfragen
entschuldigung
leider
hinweis
achtung
fehler
zurück zur startseite
"""
# The phrases of HTTP's failing statuses (RFC 9110 and its register). Those of one word need their number.
STATUSES = """
bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|proxy authentication required|request timeout|request time-out|conflict|gone|length required|precondition failed|payload too large|content too large|request entity too large|uri too long|request-uri too long|unsupported media type|range not satisfiable|requested range not satisfiable|expectation failed|i'm a teapot|misdirected request|unprocessable content|unprocessable entity|locked|failed dependency|too early|upgrade required|precondition required|too many requests|request header fields too large|unavailable for legal reasons
internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|gateway time-out|http version not supported|variant also negotiates|insufficient storage|loop detected|not extended|network authentication required
"""
SCRIPTS = """
you need to enable javascript to run this app
please enable javascript to continue
please enable javascript to view this page
please enable javascript in your browser settings to see the content
please enable javascript to view the comments
enable javascript and cookies to continue
javascript and cookies are required
javascript is required
javascript is required to use this site
javascript must be enabled in order to use this site
javascript is disabled in your browser
javascript is disabled on your browser
javascript is turned off in your web browser turn it on to use this site then refresh the page
javascript is not available we've detected that javascript is disabled in this browser please enable javascript or switch to a supported browser to continue
it looks like javascript is either disabled or not supported by your browser
your browser does not support javascript
your browser has javascript turned off
your browser does not run scripts so the page stays empty
your browser is out of date please update your browser or use a newer browser
we're sorry but this app doesn't work properly without javascript enabled please enable it to continue
this site works best with javascript enabled
this site requires javascript to work properly
this page requires javascript
this app needs scripts to run
this application needs javascript to load
this form needs javascript
this form is empty without javascript
this feature requires scripts
please turn on javascript and reload the page
please activate javascript
turn on js
activate js
switch on scripts
allow javascript first
allow scripts for this site and load the page again
enable them in your browser and reload
scripts are blocked
scripts are disabled
remove your script blocker or ad blocker and try again
please disable your ad blocker
to view this page
to see the full site
to use this page
before we can show the text
you must have cookies enabled
veuillez activer javascript
veuillez activer javascript pour afficher cette page
veuillez activer javascript dans votre navigateur puis rechargez la page
vous devez activer javascript pour continuer
javascript est désactivé dans votre navigateur
ce site nécessite javascript
cette application a besoin de javascript ou de scripts
activez les scripts dans le navigateur
autorisez javascript merci
pour voir le contenu
active javascript
active javascript para ver esta página
por favor active javascript en su navegador y recargue la página
debe habilitar javascript para continuar
javascript está desactivado en su navegador
este sitio requiere javascript
esta aplicación necesita javascript o scripts
permita los scripts para ver el contenido
permita javascript
bitte aktivieren sie javascript
bitte aktivieren sie javascript um diese seite zu nutzen
bitte javascript in den einstellungen ihres browsers einschalten und die seite neu laden
javascript ist in ihrem browser deaktiviert
javascript ist deaktiviert
diese seite benötigt javascript
für diese seite oder anwendung werden skripte benötigt
sie müssen javascript aktivieren um fortzufahren
zum anzeigen bitte skripte erlauben
"""
# Exemplars of unfilled fields, by the syntaxes of public template languages; any name may stand for "name".
FIELDS = """
{{ name }}
{{{ name }}}
{% name %}
{%- name -%}
<% name %>
<%= name %>
<%- name %>
<< name >>
#{ name }
${ name }
@@ name @@
## name ##
%% name %%
%( name )s
%( name )d
*| name |*
[ insert name ]
< insert name >
"""
# Exemplars whose signs other texts have too; their name or what stands before them must read like a field.
WEAK_FIELDS = """
$ name $
% name %
{ name }
[ name ]
[[ name ]]
__ name __
"""
# Exemplars of sentences that write about fields instead of leaving one unfilled.
MENTIONS = """
write the field in the template and the program puts the value there
in the letter template the field is filled before sending and none is left over
the pattern stands for the value and is replaced by it
the placeholder in the template is replaced by the name of the customer
the syntax of a variable in the template language
a set such as is written with braces in the notes
the rule and the list come from the manual
the module keeps its names in which the manual lists on page
in the shell it starts a text and names the folder
use the variable in the template to print the value
"""
# Words about fields; two of them in a sentence make it one that writes about fields.
ABOUT_FIELDS = frozenset("template templates placeholder placeholders syntax variable variables pattern patterns braces brackets notation manual field fields merge tag tags token tokens expands filled printed escape escaped shell".split())
# Words of which names of fields are made.
FIELD_WORDS = frozenset("account address amount city client clinic code column company contact count country currency customer date day description due email employee event field first full id image invoice last link location manager name no number order patient phone postcode price product quantity recipient rating row run status street sum surname table text time title total url user value visit year zip".split())
MENU_WORDS = """
about|accessibility|blog|basket|careers|community|contact|documentation|download|events|faq|forum|guides|help|help centre|home|imprint|investors|jobs|locations|log in|my account|news|partners|press|pricing|privacy|products|sale|search|services|shop all|sign up|sitemap|status|store|support|team|terms|topics|back to top|all rights reserved
accueil|actualités|agences|aide|à propos|compte|confidentialité|connexion|contact|emplois|équipe|haut de page|mentions légales|panier|presse|produits|recherche|services|tarifs|tous droits réservés
acerca de|aviso legal|ayuda|buscar|cesta|contacto|cuenta|empleo|entrar|equipo|inicio|noticias|precios|prensa|privacidad|productos|sedes|servicios|todos los derechos reservados|volver arriba
agb|aktuelles|alle rechte vorbehalten|anmelden|datenschutz|dienste|hilfe|impressum|karriere|kontakt|konto|nach oben|preise|presse|produkte|ratgeber|standorte|start|suche|team|über uns|warenkorb
"""
_MENU = {x for line in MENU_WORDS.strip().split("\n") for x in line.split("|")}
_MENU_WORDS = {w for x in _MENU for w in x.split()}

# A field's name in any script, with dots, and with filters behind pipes.
_NAME = r"[^\W\d]\w*(?:[ .-]\w+){0,3}(?: ?\| ?[^\W\d]\w*(?:\([^(){}\n]{0,40}\)|: ?[\w\"']{1,40})?){0,3}"
# What stands before a value: a greeting or farewell; a preposition, a possessive or a colon.
_GREETING = re.compile(r"(?i)(?:^|\W)(?:dear|hello|hi|hey|welcome|regards|sincerely|thanks|hola|estimad[oa]|querid[oa]|saludos|atentamente|bonjour|bonsoir|ch(?:er|ère)|cordialement|salutations|hallo|guten tag|liebe[rs]?|sehr geehrte[rs]?|gruß|grüßen?)(?: (?:mr|mrs|ms|dr|herr|frau|señora?|monsieur|madame)\.?)?,?\s*$")
_BEFORE_VALUE = re.compile(r"(?i)(?:^|\W)(?:for|to|from|of|in|at|by|with|your|our|para|en|con|su|nuestr[oa]|de|pour|chez|votre|notre|für|von|bei|an|mit|ihre?|unser[en]?)\s+$|:\s*$")
# Verbs whose object is the field itself, not what should stand in its place.
_WRITES = re.compile(r"(?i)\b(?:write|use|type|put|enter|paste|copy|replace|called|named|écri(?:re|vez)|utilise[rz]|tape[rz]|escrib[ae]|utilice|ponga|schreib(?:en|e|t)(?: sie)?|verwende[nt]?(?: sie)?|nutzen(?: sie)?)\s+[\"'`«„“]?$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[ ._-]+")
_WORD = re.compile(r"[^\W\d_]+")
_CODED = re.compile(r"\d{1,2}\.? [^\W\d_]+ \d{4}|\b\w*\d\w*\b")  # dates, and words that hold digits
_ARGUMENT = re.compile(r"\([^()\n]*\)|'[^'\n]*'|\"[^\"\n]*\"|(?<!\w)(?:[A-Za-z]:)?[/\\][\w./\\-]+")  # of calls, quoted, or a path
_KNOWN_NAME = re.compile(r"(?<!^)(?<![.!?:] )\b(?:[^\W\d_a-z][\w'’-]*(?: & | |$)){1,4}")
_WINDOWS = re.compile(r"\n|(?<=[.!?])\s+(?=[^\W\d_a-z]|\"|¿)|\s+[-–|/»>•·]\s+|\s{2,}")
_FOOTER = re.compile(r"(?i)^\W*(?:\(c\)|©|copyright|made in|tel\.|tél\.|fax|phone|contact:|customer desk|company number|(?:follow|suivez|s[ií]ga|folgen)\w*\b(?=.{0,60}$))|\b(?:rights reserved|droits réservés|derechos reservados|rechte vorbehalten)\b")
_MAIL = re.compile(r"^\S+(?:@| ?\[at\] ?)\S+(?: ?\[dot\] ?\S+)*$")
_POSTAL = re.compile(r"^(?:[^\W\d_][\w'&.-]*\s?){1,4},.*\d")


_PHRASES = sorted((x for line in STATUSES.strip().split("\n") for x in line.split("|")), key=len, reverse=True)
_STATUS = re.compile(rf"(?i)\W*(?:(?:http(?:/\d(?:\.\d)?)?|error|status|code)\W*){{0,3}}(?:[45]\d\d\b\W*(?:error\W*)?(?:{'|'.join(map(re.escape, _PHRASES))})|(?:{'|'.join(re.escape(x) for x in _PHRASES if ' ' in x)}))(?:\W+error)?(?:\W*\(?[45]\d\d\)?)?\W*")


def _exemplars(block: str) -> list[list[str]]:
    return [_WORD.findall(line.lower()) for line in block.strip().split("\n")]


class ResidueIndex:
    """Exemplars behind an inverted index from word to exemplar; weights from the documents' frequencies."""

    def __init__(self, shares: dict[str, float]) -> None:
        self.kinds = [*(("filler", e) for e in _exemplars(FILLER)), *(("error", e) for e in _exemplars(ERRORS)), *(("scripts", e) for e in _exemplars(SCRIPTS)), *(("mention", e) for e in _exemplars(MENTIONS))]
        words = {w for _, e in self.kinds for w in e}
        # idf from the share of documents, so that it is alike at every size; a word in no document weighs most
        self.idf = {w: 1 + math.log(1 / max(shares.get(w, 0.0), 1e-4)) for w in words}
        self.other = sum(self.idf.values()) / max(1, len(self.idf))  # weight of a word that no exemplar has
        self.total = [sum(self.idf[w] for w in set(e)) for _, e in self.kinds]
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, (_, e) in enumerate(self.kinds):
            for w in set(e):
                self.index[w].append(k)
        self.lorem = {w for _, e in self.kinds[:LOREM_LINES] for w in e}
        self.vocabulary = {kind: {w for k, e in self.kinds if k == kind for w in e} for kind in ("error", "scripts")}
        self.vocabulary["filler"] = {w for k, e in self.kinds[LOREM_LINES:] if k == "filler" for w in e} | self.lorem
        self.lorem_short = set(LOREM_SHORT)
        # exemplars of fields, from the sign that opens them, longest first
        self.fields: dict[str, list[tuple[str, bool, re.Pattern]]] = defaultdict(list)
        for block, weak in ((FIELDS, False), (WEAK_FIELDS, True)):
            for left, right in (line.split("name") for line in block.strip().split("\n")):
                opening, closing = ("".join(rf"(?i:{re.escape(x)})\s+" if x.isalpha() else rf"{re.escape(x)}\s*" for x in left.split()), r"\s*".join(["", *map(re.escape, right.split())]))
                # a line of underscores may hold no blank at its ends, and two signs no third
                tight = weak and left.strip() in ("__", "$", "%")
                name = r"[^\W_]+(?:_[^\W_]+)*" if left.strip() == "__" else _NAME
                shape = f"{re.escape(left.strip())}({name}){re.escape(right.strip())}" if tight else f"{opening}({name}){closing}"
                self.fields[left.strip()[0]].append((left.strip(), weak, re.compile(shape)))
        for same in self.fields.values():
            same.sort(key=lambda f: (f[1], -len(f[0])))
        self.opening = re.compile("|".join(sorted(map(re.escape, self.fields))))

    def coverage(self, words: list[str], mention: bool = False) -> float:
        """Share of the words' weight that retrieved exemplars contain; those on mentions, or all others."""
        have = set(words)
        shared: dict[int, float] = defaultdict(float)
        for w in have:
            for k in self.index.get(w, ()):
                shared[k] += self.idf[w]
        covered: set[str] = set()
        for k, weight in shared.items():
            kind, e = self.kinds[k]
            if (kind == "mention") != mention:
                continue
            if k < LOREM_LINES or weight >= PRESENCE * self.total[k]:
                covered |= have.intersection(e)
        if not mention and len(have & self.lorem) >= LOREM_LEAST:
            covered |= have & self.lorem_short
        weights = [self.idf.get(w, self.other) for w in words]
        inside = sum(x for w, x in zip(words, weights) if w in covered)
        return inside / sum(weights) if weights else 0.0

    def residue_like(self, words: list[str]) -> bool:
        """Whether retrieved exemplars contain a window, or the words of one kind's exemplars make it up."""
        weights = [self.idf.get(w, self.other) for w in words]
        if sum(x for w, x in zip(words, weights) if w in self.idf) < COVERAGE * sum(weights):
            return False  # no exemplar can hold a word that none has
        if self.coverage(words) >= COVERAGE:
            return True
        most = max(sum(x for w, x in zip(words, weights) if w in known) for known in self.vocabulary.values())
        return most >= VOCABULARY * sum(weights)


def _field_like(name: str) -> bool:
    """Whether at least half of a name's words are those of fields; a word may be two of them run together."""
    words = [w.lower() for w in _CAMEL.split(name) if w]
    known = [w in FIELD_WORDS or any(w[:k] in FIELD_WORDS and w[k:] in FIELD_WORDS for k in range(2, len(w) - 1)) for w in words]
    return bool(words) and sum(known) * 2 >= len(words)


def _field_by_context(whole: str, inner: str, before: str) -> bool:
    """Whether a weak shape stands where a value should, whatever its name."""
    name = inner.split("|")[0].strip()
    if len(name) < 3 or name.lower() == "dot":
        return False
    if _GREETING.search(before):
        return True
    if whole[0] == "[" or not _BEFORE_VALUE.search(before):  # brackets hold remarks and links, too
        return False
    return whole[0] == "{" or name.isupper() or "_" in name or "." in name


def _fields(text: str, index: ResidueIndex) -> Iterator[tuple[int, int]]:
    """Places of unfilled fields: exemplars retrieved by their opening sign, those of common signs judged by name and context."""
    end = 0
    for m in index.opening.finditer(text):
        at = m.start()
        if at < end:
            continue
        for left, weak, shape in index.fields[m.group()]:
            if not (hit := shape.match(text, at)):
                continue
            if weak:
                around = text[at - 1 : at]
                inner = hit.group(1)
                if left == "{" and around and (around.isalnum() or around in "{$#%_") or around == left[0]:
                    continue
                if not (_field_like(inner.split("|")[0]) or _field_by_context(hit.group(), inner, text[text.rfind("\n", 0, at) + 1 : at])):
                    continue
            yield hit.span()
            end = hit.end()
            break


def has_field(text: str, index: ResidueIndex) -> bool:
    """Whether a template field was left where a value should stand; sentences that write about fields don't count."""
    for lo, hi in _fields(text, index):
        # the sentence around the field
        left = max(text.rfind("\n", 0, lo), *(text.rfind(x, 0, lo) for x in (". ", "! ", "? "))) + 1
        rights = [r for r in (text.find("\n", hi), *(text.find(x, hi) for x in (". ", "! ", "? "))) if r >= 0]
        right = min(rights, default=len(text))
        words = _words(text[left:lo] + " " + text[hi:right])
        if not _WRITES.search(text[max(0, lo - 40) : lo]) and len(ABOUT_FIELDS.intersection(words)) < 2 and index.coverage(words, mention=True) < 0.5:
            return True
    return False


# Words that are an error message by themselves.
ALONE = frozenset("error forbidden oops tbd keyerror erreur fehler".split())
NAMES_MOST = 2  # names around residue at most


def _name_like(window: str) -> bool:
    words = window.split()
    return len(words) <= 4 and all(w[0].isupper() or w in ("&", "-") for w in words)


def _frame(window: str) -> bool:
    """Whether a window is a menu, a footer or an address."""
    bare = window.strip(" \t.*!()#0123456789[]|/-")
    if not bare or bare.lower() in _MENU or _FOOTER.search(window) or _MAIL.match(window):
        return True
    words = window.split()
    pieces = [p.strip().lower() for p in re.split(r"[|/>»•·]| - |\s{2,}", window) if p.strip()]
    if len(pieces) > 1 and all(p in _MENU for p in pieces):
        return True
    if words and all(w.strip(".,|/").lower() in _MENU_WORDS for w in words):
        return True
    return len(words) <= 14 and bool(_POSTAL.match(window)) and not window.rstrip().endswith(".")


def _stripped(window: str) -> str:
    """A window without a name or menu run together with its start."""
    return re.sub(r"^(?:(?:[A-ZÀ-Þ][\w'’-]*|&)\s+){1,12}(?=[A-ZÀ-Þ¿][^\W\d_]*\s)", "", window)


def _forms(window: str, index: ResidueIndex) -> Iterator[list[str]]:
    """A window's words; without a name or menu run together with its start; without arguments; without a name inside."""
    yield _words(window)
    for form in (_stripped(window), _ARGUMENT.sub(" ", window)):
        if form != window:
            yield _words(form)
    for form in dict.fromkeys((window, _stripped(window))):
        names = [m for m in _KNOWN_NAME.finditer(form) if not any(w in index.idf for w in _words(m.group()))]
        if len(names) == 1:
            words = _words(form[: names[0].start()] + form[names[0].end() :])
            if len(words) >= 5:
                yield words


def _words(text: str) -> list[str]:
    return _WORD.findall(_CODED.sub(" ", text).lower())


def only_residue(text: str, index: ResidueIndex) -> bool:
    """Whether a text holds nothing but residue, apart from a name, menu or footer around it."""
    hit, names = False, 0
    for line in text.split("\n"):
        found = others = 0
        for window in (w.strip() for w in _WINDOWS.split(line)):
            words = _words(window)
            if not words:
                continue
            if len(words) >= 3 and len(set(words)) <= 2:  # one or two words again and again
                found += 1
            elif _STATUS.fullmatch(window) or any(index.residue_like(w) for w in _forms(window, index)):
                found += len(words) > 1 or words[0] in ALONE  # other single words say nothing, either way
            elif not _frame(window):
                if _frame(line):  # a footer or an address may look like several windows
                    found = others = 0
                    break
                others += 1
                if names + others > NAMES_MOST or not _name_like(window):
                    return False
        names += others
        hit = hit or found > 0
    return hit


def is_residue(text: str | None, index: ResidueIndex) -> bool:
    """Null and blank texts are no residue."""
    return bool(text) and not text.isspace() and (has_field(text, index) or only_residue(text, index))


def document_shares(documents: DataFrame, text: str = "text") -> dict[str, float]:
    """Share of all documents that hold each word of the exemplars. The result is as large as the exemplars' vocabulary."""
    words = sorted({w for block in (FILLER, ERRORS, SCRIPTS, MENTIONS) for e in _exemplars(block) for w in e})
    # the set of words is built once, not for each text
    held = F.filter(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+")), lambda w: w.isin(*words))
    rows = documents.select(F.explode(F.array_append(held, F.lit("\x00"))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    total = max(1, counts.pop("\x00", 0))
    return {w: n / total for w, n in counts.items()}


def residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` of each document that is residue. Texts are read twice and not shuffled; an empty table gives no row."""
    index = ResidueIndex(document_shares(documents.filter(F.col(text).isNotNull()), text))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            forms = canonical_batch(b["text"].tolist())[0]
            yield b.loc[[is_residue(t, index) for t in forms], ["id"]]

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return rows.mapInPandas(find, "id long").select(F.col("id").alias(key))


def without_residue(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are no residue, with all their columns; rows whose key is null are kept."""
    return documents.join(residue(documents, key, text), key, "left_anti")
