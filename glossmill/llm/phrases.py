"""Phrases of a site's machinery: fixed values, all in lower case, digits written as 0.

A notice is made of parts: how it begins (HEADS), what makes it one (ANCHORS), how
it goes on (TAILS). Only ANCHORS decide; heads and tails count towards coverage.
WHOLE are notices or instructions that count only where they are all of a line or
sentence. SURE are enough wherever they stand.
"""

from __future__ import annotations

HEADS = """
the page
this page
the page you were looking for
the page you requested
the requested page
the article
this article
the chapter
this chapter
the entry
this entry
the record
this record
the resource
the requested resource
the document
the file
the item
the lesson
the address
that address
the requested address
the url
your request
the request
your session
the session
the server
the upstream service
the service
the site
this site
this website
the website
the connection
the database
the application
the operation
the link
you
sorry, but
sorry,
we're sorry, but
oops!
error 000
error
please
please enable
you need to enable
you must enable
you need to turn on
you have to turn on
turn on
switch on
activate
enable
to continue, activate
to continue, enable
to continue, turn on
we could not detect
we couldn't detect
this reader requires
this page requires
this site requires
this website requires
this application requires
this app requires
requires
needs
it seems that
it looks like
your browser does not support
cette page nécessite
ce site nécessite
veuillez activer
activez
vous devez activer
la page
la page demandée
le serveur
l'article
cet article
cette page
esta página requiere
este sitio requiere
active
active los
habilite
debe activar
por favor, active
la página
la página solicitada
el servidor
el artículo
bitte aktivieren sie
aktivieren sie
diese seite benötigt
diese seite erfordert
diese website benötigt
die seite
die angeforderte seite
der server
auf dem server
der artikel
请
请启用
请开启
本页需要
页面
服务器
questa pagina richiede
abilita
esta página requer
ative
allow
erreur
fehler
errore
erro
this app
this application
questo sito richiede
questo sito
este site requer
cette application
esta aplicación
diese anwendung
ce site
este sitio
diese website
le lien
el enlace
der link
le fichier
el archivo
die datei
la ressource
el recurso
die ressource
la conexión
la connexion
die verbindung
la base de datos
la base de données
die datenbank
la demande
la requête
la solicitud
die anfrage
la session
la sesión
die sitzung
désolé,
lo sentimos,
leider
desculpe,
spiacenti,
"""

ERRORS = """
could not be found
can not be found
cannot be found
can't be found
couldn't be found
was not found
was not found on this server
is not found
could not be loaded
cannot be loaded
failed to load
could not be displayed
cannot be displayed
could not be opened
could not be retrieved
could not be reached
could not be rendered
failed to render
returned no data
returned an error
does not exist
doesn't exist
no longer exists
is no longer available
has been moved
has been removed
has been deleted
is unavailable
is temporarily unavailable
is currently unavailable
is not available
cannot be shown
can't be shown
could not be shown
timed out
has timed out
has expired
did not respond
is not responding
was blocked
has been blocked
is blocked
was rejected
was interrupted
was cancelled
is locked
is restricted
is empty
could not be processed
could not be completed
could not be verified
could not be read
could not be saved
could not be established
cannot be opened
cannot be accessed
returned an empty response
took too long to respond
is down for maintenance
is under maintenance
encountered an error
encountered an internal error
met an internal problem
met an unexpected condition
could not finish your request
could not complete your request
could not process your request
cannot process your request
do not have permission
don't have permission
are not authorized
are not authorised
to the database failed
was refused
was reset
is broken
too many requests were made
wait a moment and try again
an unexpected error occurred
an error occurred
an error has occurred
est introuvable
n'existe pas
n'existe plus
n'est pas disponible
est indisponible
est temporairement indisponible
n'a pas été trouvée
n'a pas pu être chargée
a rencontré une erreur interne
a rencontré une erreur
a expiré
a été bloquée
a été supprimée
n'a pas répondu
une erreur est survenue
une erreur s'est produite
vous n'avez pas la permission
vous n'avez pas l'autorisation
vous n'êtes pas autorisé
no se ha encontrado
no se ha encontrado la página solicitada
no se encontró
no se encuentra
no existe
ya no existe
no está disponible
encontró un error interno
ha encontrado un error
ha caducado
fue bloqueada
no respondió
no responde
se ha producido un error
ha ocurrido un error
no tiene permiso
no tiene permiso para ver esta entrada
no se pudo cargar
wurde nicht gefunden
konnte nicht gefunden werden
existiert nicht
existiert nicht mehr
ist nicht verfügbar
ist derzeit nicht verfügbar
ist nicht erreichbar
ist ein interner fehler aufgetreten
ist ein fehler aufgetreten
ein fehler ist aufgetreten
es ist ein fehler aufgetreten
konnte nicht geladen werden
ist abgelaufen
wurde blockiert
hat nicht geantwortet
antwortet nicht
sie haben keine berechtigung
sie sind nicht berechtigt
non è stata trovata
não foi encontrada
页面不存在
页面未找到
找不到页面
找不到该页面
无法找到
无法显示
无法加载
服务器错误
服务器内部错误
内部错误
服务不可用
没有权限
无权访问
访问被拒绝
发生错误
出错了
已过期
access denied
access is denied
access forbidden
permission denied
page not found
accès refusé
accès interdit
page introuvable
page non trouvée
ressource introuvable
erreur interne du serveur
erreur de serveur
délai d'attente dépassé
n'a pas pu être affichée
n'a pas pu être affiché
n'a pas pu être trouvé
n'a pas pu être chargé
n'a pas été trouvé
est vide
a été déplacée
a été déplacé
a été supprimé
ne répond pas
ne peut pas être affichée
ne peut pas être affiché
acceso denegado
acceso prohibido
página no encontrada
recurso no encontrado
error interno del servidor
tiempo de espera agotado
no se pudo mostrar
no se pudo encontrar
no se puede mostrar
ha sido eliminada
ha sido eliminado
ha sido movida
fue eliminada
ya no está disponible
zugriff verweigert
zugriff nicht erlaubt
seite nicht gefunden
interner serverfehler
zeitüberschreitung
konnte nicht angezeigt werden
kann nicht angezeigt werden
wurde gelöscht
wurde verschoben
wurde entfernt
ist nicht mehr verfügbar
ist leer
accesso negato
pagina non trovata
acesso negado
página não encontrada
禁止访问
访问受限
请求超时
连接超时
页面无法显示
无法打开
服务器无响应
服务器没有响应
内容不存在
链接已失效
已被删除
"""

SCRIPTS = """
javascript
javascript and cookies
cookies and javascript
js
scripts
scripting
active scripting
client-side scripting
script support
les scripts
los scripts
skripte
scripts no navegador
脚本
javascript后
cookies
javascript support
javascript activé
javascript activado
javascript aktiviert
"""

TAILS = """
on this server
on our server
in this library
from the archive
right now
at the moment
at this time
for now
to guests
or deleted
or removed
or has been moved
or has been moved or deleted
(code e-00)
(code e-000)
code e-00
in time
and reload
and reload the page
and cookies
and refresh
in your browser
in your browser settings
to view this page
to view this site
to view this entry
to view this content
to see this page
to use the library
to use this site
to use this app
to run this app
to continue
before the article can be shown
before the page can be shown
your browser has it blocked
it is disabled in your browser
is disabled in your browser
for this page
for this entry
to access this page
to access this resource
pour afficher cette page
pour continuer
dans votre navigateur
sur ce serveur
en su navegador
en tu navegador
para ver esta página
para continuar
en este servidor
in ihrem browser
um die seite anzuzeigen
um fortzufahren
für diesen eintrag
auf diesem server
and could not finish your request
your request
this page
the page
后重新加载本页
重新加载本页
以继续
后刷新
在浏览器中
nel browser
to this article
to this page
to this entry
to this resource
to work
to work properly
to function
to run
per funzionare
para funcionar
pour fonctionner
um zu funktionieren
à cet article
à cette page
à cette entrée
à cette ressource
a este artículo
a esta página
a este recurso
a esta entrada
auf diesen artikel
auf diese seite
auf diese ressource
auf diesen eintrag
pour le moment
por el momento
en este momento
zurzeit
derzeit
为该页面
此页面
本页面
该文章
"""

WHOLE = """
not found
page not found
000 not found
forbidden
000 forbidden
access denied
permission denied
unauthorized
000 unauthorized
bad request
000 bad request
bad gateway
000 bad gateway
gateway timeout
service unavailable
000 service unavailable
internal server error
000 internal server error
too many requests
000 too many requests
something went wrong
an error occurred
oops! something went wrong
error 000
http error 000
error: 000
erreur 000
fehler 000
página no encontrada
error interno
acceso denegado
page introuvable
accès refusé
erreur interne du serveur
seite nicht gefunden
zugriff verweigert
interner serverfehler
页面不存在
请返回首页
loading
loading...
please wait
replace this text
replace this text with your own
replace this text with your own text
replace this with your own text
your text here
your text goes here
text goes here
text here
insert text here
insert your text here
insert content here
insert title here
insert caption here
insert description here
insert image here
enter text here
enter your text here
type here
add text
add text here
add your text here
add content here
add a description
add title here
body copy here
body copy goes here
body text here
lead paragraph goes here
paragraph goes here
content goes here
title goes here
description goes here
caption goes here
headline goes here
section title
section heading
section text to be supplied by the author
text to be supplied by the author
to be supplied by the author
to be written
to be completed
to be added
to be determined
to be announced
tbd
tba
todo
todo: write this section
todo: write this
todo: add text
fixme
click to edit
click to edit this paragraph
click here to edit
click to add text
click to add title
double-click to edit
short description
short description (max 000 characters)
description (max 000 characters)
max 000 characters
write a short introduction here
write a short summary here
write your text here
write something here
write here
write two or three sentences about the topic here
write one or two sentences about the topic here
describe the topic here
describe the image here
this is a placeholder
placeholder
placeholder text
placeholder paragraph
sample text
dummy text
filler text
lorem ipsum
coming soon
content coming soon
more text to come
text to follow
page under construction
this page is under construction
under construction
untitled document
untitled
new page
example text
remplacez ce texte
remplacez ce texte par le vôtre
insérer le texte ici
insérez le texte ici
insérez votre texte ici
votre texte ici
texte à insérer
texte à venir
titre de la section
titre à compléter
texte de remplissage
texte provisoire
à compléter
à rédiger
reemplace este texto
reemplace este texto por el suyo
insertar texto aquí
inserte texto aquí
inserte su texto aquí
escriba aquí
escriba su texto aquí
su texto aquí
título de la sección
texto de relleno
texto provisional
por completar
bitte text einfügen
text hier einfügen
hier text einfügen
ihr text hier
ihr text
hier steht ihr text
ersetzen sie diesen text
ersetzen sie diesen text durch ihren eigenen
diesen text ersetzen
platzhaltertext
platzhalter
blindtext
überschrift des abschnitts
abschnittstitel
titel des abschnitts
beispieltext
noch auszufüllen
此处填写正文
此处填写标题
此处填写内容
请在此处输入文字
请在此输入文字
请输入内容
在此处插入文字
请替换此文本
占位文本
占位符
待补充
待完善
章节标题
示例文本
inserisci qui il testo
testo segnaposto
insira o texto aqui
error
erreur
fehler
pendiente
pendiente de redactar
pendiente de completar
pendiente de revisión
por redactar
por escribir
por definir
texto pendiente
contenido pendiente
en construcción
página en construcción
próximamente
contenido próximamente
añadir texto
añada texto aquí
sustituya este texto
sustituya este texto por el suyo
haga clic para editar
título aquí
à écrire
à définir
à remplir
contenu à venir
en construction
page en construction
bientôt disponible
ajouter du texte
ajoutez votre texte ici
écrivez ici
écrivez votre texte ici
cliquez pour modifier
titre ici
noch zu schreiben
noch zu verfassen
noch zu ergänzen
noch zu erstellen
wird noch ergänzt
wird noch geschrieben
text folgt
inhalt folgt
im aufbau
seite im aufbau
demnächst verfügbar
text hinzufügen
hier schreiben
titel hier einfügen
zum bearbeiten klicken
待撰写
待编写
待定
内容待补充
内容待定
内容建设中
页面建设中
建设中
敬请期待
点击编辑
在此输入文字
此处插入图片
请填写内容
testo in arrivo
in costruzione
pagina in costruzione
em construção
página em construção
em breve
write your introduction here
add introduction here
add an introduction
add summary here
content to be added
text to be added
to be filled in
this section is empty
this section needs content
"""

SURE = """
traceback (most recent call last)
[object object]
nan/nan/nan
noscript
fatal error: uncaught
uncaught exception
uncaught typeerror
stack trace:
undefined index:
warning: mysql
operationalerror:
you have an error in your sql syntax
nullpointerexception
err_connection_timed_out
err_connection_refused
err_connection_reset
err_name_not_resolved
err_internet_disconnected
err_too_many_redirects
dns_probe_finished
checking your browser before accessing
this site can't be reached
this page isn't working
this webpage is not available
your connection is not private
please complete the security check
verify you are human
verifying you are human
are you a robot
segmentation fault
unhandled exception
parse error: syntax error
"""

#: Words that, said over and over, fill space.
FILLER = """
test
asdf
dummy
xxx
foo
bar
blah
bla
qwerty
sample text
placeholder
filler
text
lorem
ipsum
aaa
abc
prueba
essai
测试
"""

LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore
magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint
occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
"""


def lines(text: str) -> list[str]:
    return [line for line in text.splitlines() if line]
