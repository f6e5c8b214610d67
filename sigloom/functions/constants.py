"""Published constants that columns and numpy share."""

# E1(x) by Abramowitz and Stegun, in their order.
# 5.1.53, x up to 1: a0 to a5 of the polynomial that is added to -ln x
E1_NEAR = (-0.57721566, 0.99999193, -0.24991055, 0.05519968, -0.00976004, 0.00107857)
# 5.1.56, x from 1: numerator and denominator, from x ** 4 to x ** 0, over x * exp(x)
E1_FAR_ABOVE = (1.0, 8.5733287401, 18.0590169730, 8.6347608925, 0.2677737343)
E1_FAR_BELOW = (1.0, 9.5733223454, 25.6329561486, 21.0996530827, 3.9584969228)
