"""Trusted residue: sentences whose label is known (fixed values).

Words that usually vary (page, file, model ...) stand as a few examples; near-duplicate search takes care of the others. Besides the
sentences seen in labelled texts there are the reason phrases of HTTP and common messages of browsers and servers.
"""

from __future__ import annotations

from http import HTTPStatus

ERROR = """
page not found
not found
nothing here
oops
oops something went wrong
hmm we re having trouble finding that site
this page was deleted or never existed
we could not find the page you are looking for
the page you requested has moved or no longer exists
the link you followed may be broken
the requested url was not found on this server
this site can t be reached
server not found
you have sent more requests than your plan allows
too many calls from this address
rate limit exceeded
quota reached
the free quota for this model is used up
the model endpoint did not answer in time
the upstream server sent an invalid response
the origin server returned an invalid reply
an unexpected condition was met while loading this page
the service is overloaded at the moment
something went wrong on our side
internal server error
the server encountered an error and could not complete your request
we are down for maintenance and will be back shortly
be right back
confirm that you are not a robot before you proceed
checking your connection this takes a few seconds
request blocked
your address was flagged by our firewall
access denied
you do not have permission to view this page
sign in required
your session has expired
this page is not available in your region
gateway timeout
error 0
0 forbidden
0 unauthorized
0 gone
http error 0
http 0
erreur 0
erreur serveur 0
page introuvable
la page demandée est introuvable
le serveur n a pas répondu à temps
votre session a expiré
accès refusé
trop de requêtes
trop de requêtes ont été envoyées
service indisponible
vous n avez pas les droits nécessaires pour cette page
impossible de charger la page
fehler 0
serverfehler 0
seite nicht gefunden
die angeforderte seite wurde nicht gefunden
dienst nicht verfügbar
der dienst ist vorübergehend nicht erreichbar
es wurden zu viele anfragen gesendet
ihre sitzung ist abgelaufen
zugriff verweigert
ihnen fehlt die berechtigung für diese seite
error interno del servidor
servicio no disponible
el servidor tardó demasiado en responder
se han enviado demasiadas peticiones
su sesión ha caducado
acceso denegado
no tiene permiso para ver esta página
la página solicitada no existe
no se ha encontrado la página
página no encontrada
""".strip().split("\n") + sorted({x for s in HTTPStatus if s >= 400 for x in (f"0 {s.phrase.lower()}", s.phrase.lower(), s.description.lower()) if " " in x})

# What is wanted and what shows it, by language, and the notices about scripts with these in their places.
_PURPOSES = {
    "en": ("continue", "view this page", "open the notebook", "run this app", "see the dataset card", "use the playground"),
    "fr": ("continuer", "afficher cette page", "ouvrir le tableau", "lancer l application"),
    "de": ("um fortzufahren", "um die ansicht zu öffnen", "um diese seite anzuzeigen", "um die anwendung zu starten"),
    "es": ("continuar", "ver esta página", "abrir la tabla", "iniciar la aplicación"),
}
_THINGS = {
    "en": ("the page", "this viewer", "the model page", "the dataset browser", "this site"),
    "fr": ("la page", "cette page", "la fiche du modèle"),
    "de": ("die ansicht", "diese seite", "das notizbuch", "diese anwendung"),
    "es": ("la página", "este visor", "la ficha del modelo"),
}


def _filled(templates: dict[str, str]) -> list[str]:
    """The templates, one a line, with each purpose in place of ``TO`` and each thing in place of ``IT``."""
    out = []
    for lang, lines in templates.items():
        for line in lines.strip().split("\n"):
            fillers = _PURPOSES[lang] if "TO" in line else _THINGS[lang] if "IT" in line else ("",)
            out += [line.replace("TO", x).replace("IT", x) for x in fillers]
    return out


SCRIPT = _filled({
    "en": """
javascript is required to TO
please enable javascript to TO
you need to enable javascript to TO
to TO switch javascript on
IT needs javascript
IT does not work without javascript
IT relies on javascript which is off
without javascript IT stays empty
your browser has javascript disabled so IT cannot be shown
please turn on javascript in your browser and reload
allow javascript in your browser settings
allow javascript in settings
your browser does not support javascript
javascript seems to be blocked
javascript is disabled
scripts are not running
""",
    "fr": """
veuillez activer javascript pour TO
IT ne fonctionne pas sans javascript
javascript est désactivé
les scripts sont bloqués par votre navigateur
""",
    "de": """
bitte aktivieren sie javascript TO
aktivieren sie javascript TO
ohne javascript kann IT nicht starten
javascript ist ausgeschaltet daher bleibt IT leer
skripte sind in ihrem browser gesperrt
""",
    "es": """
active javascript para TO
IT no funciona sin javascript
javascript está desactivado y no se puede TO
su navegador tiene bloqueados los scripts
""",
})

FILLER = """
sample text goes here
your text goes here
text to be supplied later
this is placeholder copy for the final article
some more sample text to fill the box
body copy body copy body copy
dummy paragraph used to check the layout
nothing to read here yet only text for spacing
texte de remplissage pour la maquette
ceci est un faux texte
le contenu définitif viendra plus tard
exemple de paragraphe sans contenu
encore un paragraphe de remplissage
encore un paragraphe
noch ein satz ohne inhalt
dies ist ein blindtext
beispieltext zur prüfung des layouts
hier steht später der richtige inhalt
platzhaltertext
este es un texto de relleno
texto de ejemplo para comprobar el diseño
aquí irá el contenido definitivo
otro párrafo sin contenido
""".strip().split("\n")

# What surrounds a notice: navigation, advice, marks of requests. It is no content, but no residue by itself either.
FURNITURE = """
home
datasets
models
docs
sign in
error
code
status
message
detail
type
server
edge
x trace
content type
content length
text html
request id
request id 0
ref
ref 0 0
retry after
retry after 0 seconds
http 0 0 error
reload page
contact support
cookie settings
imprint
return to the start page
go back
slow down
check the address and reload
check the address
change your settings and reload
log in again to continue
please try again in a few minutes
please try again later
if the problem persists contact the site owner
quote reference 0 when you write to us
traceback most recent call last
file
line 0 in fetch
raise httperror resp
httperror
accueil
données
modèles
connexion
réf
réf 0
recharger la page
réessayez plus tard
reconnectez vous
revenez à l accueil
contactez le support
impossible de montrer les données
start
daten
modelle
anmelden
kennung 0
seite neu laden
versuchen sie es später noch einmal
zurück zur startseite
bitte melden sie sich erneut an
wenden sie sich an den betreiber
inicio
datos
modelos
entrar
recargar la página
vuelva al inicio
inténtelo más tarde
inicie sesión de nuevo
avise al administrador
""".strip().split("\n")
FURNITURE += _filled({"en": "allow it for this site to TO\nIT needs them", "fr": "autorisez les pour TO\nIT les nécessite", "de": "IT braucht sie", "es": "permítalos para TO\nIT los necesita"})

SEEDS: list[tuple[str, str]] = [(kind, x) for kind, some in (("error_page", ERROR), ("script_notice", SCRIPT), ("filler", FILLER), ("furniture", FURNITURE)) for x in some]
