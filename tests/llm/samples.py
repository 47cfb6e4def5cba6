"""Small multilingual fixtures, written for these tests."""

import random

PARTS = {
    "en": (["The baker", "Our neighbour", "The old teacher", "A young doctor"], ["opens the shop", "repairs the bicycle", "reads a long letter", "paints the kitchen wall"], ["before breakfast", "when it rains", "with great care", "every second week"]),
    "de": (["Der Bäcker", "Unser Nachbar", "Die alte Lehrerin", "Ein junger Arzt"], ["öffnet den Laden", "repariert das Fahrrad", "liest einen langen Brief", "streicht die Küchenwand"], ["vor dem Frühstück", "wenn es regnet", "mit großer Sorgfalt", "jede zweite Woche"]),
    "fr": (["Le boulanger", "Notre voisin", "La vieille institutrice", "Un jeune médecin"], ["ouvre la boutique", "répare le vélo", "lit une longue lettre", "peint le mur de la cuisine"], ["avant le petit déjeuner", "quand il pleut", "avec beaucoup de soin", "toutes les deux semaines"]),
    "es": (["El panadero", "Nuestro vecino", "La vieja maestra", "Un joven médico"], ["abre la tienda", "repara la bicicleta", "lee una carta larga", "pinta la pared de la cocina"], ["antes del desayuno", "cuando llueve", "con mucho cuidado", "cada dos semanas"]),
    "nl": (["De bakker", "Onze buurman", "De oude lerares", "Een jonge dokter"], ["opent de winkel", "repareert de fiets", "leest een lange brief", "verft de muur van de keuken"], ["voor het ontbijt", "wanneer het regent", "met veel zorg", "om de twee weken"]),
    "pt": (["O padeiro", "Nosso vizinho", "A velha professora", "Um jovem médico"], ["abre a loja", "conserta a bicicleta", "lê uma carta comprida", "pinta a parede da cozinha"], ["antes do café da manhã", "quando está chovendo", "com muito cuidado", "a cada duas semanas"]),
    "it": (["Il fornaio", "Il nostro vicino", "La vecchia maestra", "Un giovane medico"], ["apre il negozio", "ripara la bicicletta", "legge una lunga lettera", "dipinge il muro della cucina"], ["prima di colazione", "quando piove", "con molta cura", "ogni due settimane"]),
    "ru": (["Пекарь", "Наш сосед", "Старая учительница", "Молодой врач"], ["открывает лавку", "чинит велосипед", "читает длинное письмо", "красит стену на кухне"], ["перед завтраком", "когда идёт дождь", "очень старательно", "каждую вторую неделю"]),
}


def sentence(lang: str, rng: random.Random) -> str:
    return " ".join(rng.choice(p) for p in PARTS[lang]) + "."


def text(lang: str, n: int, rng: random.Random) -> str:
    return " ".join(sentence(lang, rng) for _ in range(n))
