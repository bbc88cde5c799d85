"""Published results used as golden numbers."""

# label, F1 of the baseline run, F1 of the tuned run, difference
PER_CLASS = [
    ("embarrassment", 0.0, 0.4727272727272727, 0.4727272727272727),
    ("nervousness", 0.0, 0.30303030303030304, 0.30303030303030304),
    ("disappointment", 0.15476190476190477, 0.31759656652360513, 0.16283466176170036),
    ("pride", 0.0, 0.1111111111111111, 0.1111111111111111),
    ("realization", 0.1282051282051282, 0.23923444976076555, 0.11102932155563736),
    ("annoyance", 0.2549019607843137, 0.32388663967611336, 0.06898467889179966),
    ("sadness", 0.536, 0.5889967637540453, 0.05299676375404527),
    ("confusion", 0.39090909090909093, 0.4377104377104377, 0.04680134680134679),
    ("anger", 0.48338368580060426, 0.520618556701031, 0.03723487090042671),
    ("caring", 0.4095238095238095, 0.4444444444444444, 0.03492063492063491),
    ("disgust", 0.44047619047619047, 0.4744186046511628, 0.033942414174972346),
    ("curiosity", 0.5164835164835165, 0.5487012987012987, 0.032217782217782154),
    ("desire", 0.4666666666666667, 0.49645390070921985, 0.02978723404255318),
    ("surprise", 0.5365853658536586, 0.5653710247349824, 0.028785658881323783),
    ("optimism", 0.535483870967742, 0.5633802816901409, 0.0278964107223989),
    ("approval", 0.41245136186770426, 0.43450479233226835, 0.022053430464564094),
    ("disapproval", 0.3619047619047619, 0.37424547283702214, 0.012340710932260246),
    ("excitement", 0.4027777777777778, 0.4134078212290503, 0.010630043451272497),
    ("amusement", 0.8207024029574861, 0.8226950354609929, 0.001992632503506786),
    ("gratitude", 0.9224011713030746, 0.9230769230769231, 0.0006757517738484875),
    ("grief", 0.0, 0.0, 0.0),
    ("relief", 0.0, 0.0, 0.0),
    ("fear", 0.6857142857142857, 0.6741573033707865, -0.011556982343499222),
    ("joy", 0.6202090592334495, 0.6052631578947368, -0.014945901338712653),
    ("admiration", 0.718407960199005, 0.7013953488372093, -0.01701261136179566),
    ("love", 0.8247422680412371, 0.8063872255489022, -0.018355042492334883),
    ("remorse", 0.6942148760330579, 0.6518518518518519, -0.042363024181205966),
    ("neutral", 0.63552, 0.5811732605729877, -0.05434673942701229),
]

# metric, baseline run, tuned run, change in percent
RUNS = [
    ("f1_micro", 0.5881582639603404, 0.5777663141604333, -1.7668628389123215),
    ("f1_macro", 0.42687239698087376, 0.4784228517478094, 12.076314873375473),
    ("loss", 0.08365059488398187, 0.08771152396083755, -4.8546326329034875),
]

# dialogue label -> support, accuracy of the epochs 0, 1, 2
DIALOGUE = {
    "neutral": (470, 0.9000, 0.9383, 0.9128), "joy": (163, 0.5031, 0.4479, 0.4417),
    "surprise": (150, 0.3333, 0.3400, 0.2000), "anger": (153, 0.0784, 0.2484, 0.2941),
    "sadness": (111, 0.0000, 0.0000, 0.0631), "disgust": (22, 0.0000, 0.0000, 0.0000),
    "fear": (40, 0.0000, 0.0000, 0.0000),
}
# overall accuracy of the epochs and the number of right rows it stands for
OVERALL = [(0.5113, 567), (0.5437, 603), (0.5257, 583)]
