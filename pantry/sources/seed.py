"""The curated vocabulary that answers when the full one cannot, and both closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pantry.plans.schema import VOCABULARY

# Identifiers without their "en:" prefix. The name of each is its identifier with blanks for
# hyphens and a capital first, unless the name follows after "=".
CATEGORIES = """
beverages
breakfast-cereals
breads
cakes
candies
cereals-and-potatoes
cheeses
chips-and-crisps
chocolate-bars
chocolates
cocoa-and-chocolate-products
coffee
condiments
cookies
dairy-desserts
dried-fruits
energy-drinks
fermented-milk-products
fish
fruit-juices
fruits-and-vegetables-based-foods
ice-creams
jams
legumes
margarines
meats
milk
mineral-waters
mixed-salads
nuts
oils
pasta
pastries
plant-based-milks = Plant-based milks
prepared-meals
processed-meats
rice
sauces
snacks
soft-drinks
soups
spreads
sugars
sweetened-beverages
tea
vegetables
waters
wines
yogurts
baby-foods
cereals
crackers
dairy-products
fats
flavoured-waters
flour
fresh-cheeses
fruit-beverages
honey
ketchup
muesli
mustard
noodles
olive-oils
plant-based-foods = Plant-based foods
potato-chips
protein-bars
salted-snacks
sandwiches
seafood
seeds
soy-beverages
spices
sugar-substitutes
sweet-snacks
teas
vinegars
whipped-creams
whole-wheat-breads
"""

LABELS = """
organic
fair-trade
no-gluten
gluten-free
vegan
vegetarian
no-added-sugar
no-artificial-colors
no-artificial-flavors
no-preservatives
non-gmo = Non GMO
kosher
halal
lactose-free
eu-organic = EU Organic
usda-organic = USDA Organic
rainforest-alliance = Rainforest Alliance
made-in-france = Made in France
bio
whole-grain
low-fat
low-sugar
low-sodium
high-protein
high-fiber
no-gluten-containing-ingredients = No gluten-containing ingredients
palm-oil-free
without-palm-oil
fr-bio = FR Bio
made-in-germany = Made in Germany
"""

ALLERGENS = """
gluten
milk
eggs
fish
shellfish = Shellfish (Crustaceans)
peanuts
soybeans
tree-nuts
celery
mustard
sesame-seeds
sulphur-dioxide-and-sulphites
lupin
molluscs
nuts = Nuts (general)
wheat
rye
barley
oats
lactose
almonds
cashews
walnuts
hazelnuts
pecans
pistachios
brazil-nuts
"""

ADDITIVES = """
e100 = E100 Curcumin
e102 = E102 Tartrazine
e110 = E110 Sunset yellow FCF
e120 = E120 Cochineal
e122 = E122 Azorubine
e124 = E124 Ponceau 4R
e129 = E129 Allura red AC
e131 = E131 Patent blue V
e133 = E133 Brilliant blue FCF
e160a = E160a Carotenes
e200 = E200 Sorbic acid
e202 = E202 Potassium sorbate
e210 = E210 Benzoic acid
e211 = E211 Sodium benzoate
e220 = E220 Sulphur dioxide
e250 = E250 Sodium nitrite
e251 = E251 Sodium nitrate
e300 = E300 Ascorbic acid (Vitamin C)
e301 = E301 Sodium ascorbate
e306 = E306 Tocopherols (Vitamin E)
e322 = E322 Lecithins
e322i = E322i Soya lecithin
e330 = E330 Citric acid
e331 = E331 Sodium citrates
e407 = E407 Carrageenan
e412 = E412 Guar gum
e414 = E414 Acacia gum
e415 = E415 Xanthan gum
e420 = E420 Sorbitol
e421 = E421 Mannitol
e422 = E422 Glycerol
e440 = E440 Pectins
e450 = E450 Diphosphates
e471 = E471 Mono- and diglycerides of fatty acids
e500 = E500 Sodium carbonates
e503 = E503 Ammonium carbonates
e621 = E621 Monosodium glutamate (MSG)
e627 = E627 Disodium guanylate
e631 = E631 Disodium inosinate
e951 = E951 Aspartame
e952 = E952 Cyclamic acid
e954 = E954 Saccharin
e955 = E955 Sucralose
e960 = E960 Steviol glycosides
"""

COUNTRIES = """
france
united-states = United States
germany
united-kingdom = United Kingdom
spain
italy
belgium
netherlands
switzerland
canada
australia
brazil
china
india
japan
mexico
portugal
poland
austria
sweden
denmark
norway
finland
argentina
south-africa = South Africa
new-zealand = New Zealand
singapore
south-korea = South Korea
russia
turkey
"""

# The closed vocabularies.
NOVA = {
    "1": "Unprocessed or minimally processed foods",
    "2": "Processed culinary ingredients",
    "3": "Processed foods",
    "4": "Ultra-processed food and drink products",
}
GRADE_WORDS = ("Highest", "Good", "Average", "Below average", "Lowest")


def _entries(block: str) -> list[tuple[str, str]]:
    out = []
    for line in block.split("\n"):
        slug, _, name = line.partition(" = ")
        if slug:
            out.append((f"en:{slug}", name or slug.replace("-", " ").capitalize()))
    return out


def vocabulary() -> dict[str, list[tuple[str, str]]]:
    """Facet to (id, name) in curated order."""
    return {
        "categories": _entries(CATEGORIES),
        "labels": _entries(LABELS),
        "allergens": _entries(ALLERGENS),
        "additives": _entries(ADDITIVES),
        "countries": _entries(COUNTRIES),
        "nova_groups": [(k, f"NOVA {k} — {v}") for k, v in NOVA.items()],
        "nutrition_grades": [(g, f"Nutri-Score {g.upper()} — {w} nutritional quality") for g, w in zip("abcde", GRADE_WORDS)],
    }


def seed(spark: SparkSession) -> DataFrame:
    """The curated vocabulary as a table: facet, ord, id, name, products."""
    rows = [(facet, i, id_, name, None) for facet, entries in vocabulary().items() for i, (id_, name) in enumerate(entries)]
    return spark.createDataFrame(rows, VOCABULARY)
