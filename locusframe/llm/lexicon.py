"""Seed words for the content tagger: a feature of the tagger, never a verdict by themselves."""

# Words of common speech in eight languages, lower case, by class.
INSULTS = """
idiot moron imbecile cretin fool bastard bitch whore slut asshole arsehole scumbag maggot pig piece vermin filth rats scum retard loser
mistkerl hurensohn wichser arschloch versager schlampe dreckskerl trottel
imbécil gilipollas puta cerdo cabrón idiota inútil basura escoria zorra
connard salope débile ordure crétin enfoiré abruti pute vermine
coglione bastardo stronzo cretino troia feccia deficiente
cabrão otário imbecil vadia lixo burro
debil skurwysyn dziwka śmieć śmiecie kretyn gnój szmata
идиот ублюдок сука мразь тварь сволочь дебил урод придурок
""".split()
SEXUAL = """
fuck fucking tits cock cunt pussy naked thrust moaned panties licked suck
ficken schwanz nackt lutsch titten follarte polla chúpame desnuda baiser bite suce nue
scopare cazzo nuda succhiami foder pau chupa nua zerżnąć naga jęczała трахнуть голая стонала соси
""".split()
VIOLENCE = """
kill shoot hang burn strangle strangled drown drowned throat skull bullet exterminate sterilise choke smash
verreck umbringen erschießen schädel aufhängen matar exterminarlos quemad sacrificarla tuer pendre exterminer fracasse crève
ammazzo impiccati uccidere sterminare morire enforcar exterminar zabiję zdechnij powiesić убью сдохни убить повесить сжечь
""".split()
CLASSES = {1: INSULTS, 2: SEXUAL, 3: VIOLENCE}

# Letters that look alike (Cyrillic and Greek to Latin) and digits or signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнοαεικρτυν", "aeopcyxijsdhkmtbhoaeikptuv"))
LEET = dict(zip("013457@$€", "oieastase"))
